import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_smoke(spark):
    assert entry.entry(spark).count() >= 0


@pytest.mark.parametrize("name", ["ownership_rank", "dir_composition", "call_flow_outgoing", "callees", "find_glob"])
def test_plans_have_no_cartesian_product(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan


def _resolved(spark):
    from codestrata.plans.adapter import spark_table

    return {(r["caller_id"], r["callee_id"]) for r in spark_table(spark, SF, "k_calls").filter("callee_id is not null").collect()}


def test_cycles_over_all_resolved_calls(spark):
    edges = all_edges = _resolved(spark)
    while True:
        sources, targets = {a for a, _ in edges}, {b for _, b in edges}
        kept = {(a, b) for a, b in edges if a in targets and b in sources}
        if kept == edges:
            break
        edges = kept
    got = [r["node"] for r in entry.queries()["include_cycle"](spark, SF).collect()]
    assert len(all_edges) > 100 and sorted(got) == sorted({a for a, _ in edges})


def test_levels_over_all_resolved_calls(spark):
    edges, want, frontier = _resolved(spark), {0: 0}, {0}
    for level in (1, 2, 3):
        frontier = {b for a, b in edges if a in frontier} - set(want)
        want |= dict.fromkeys(frontier, level)
    got = [(r["node"], r["level"]) for r in entry.queries()["bfs_depth3"](spark, SF).collect()]
    assert len(want) > 1 and sorted(got) == sorted(want.items())
