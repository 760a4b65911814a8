"""Registered queries against their SQL twins on the driver's small tables."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
NAMES = """ownership_match ownership_match_rank unclaimed_files listing_orders merged_order listing_columns resolve_tiers bounded_exploration shortest_path call_sites_limited program_headers eligible_domains type_relationships structure_report
 text_hits doc_rank planted_faults preorder_members ancestry_labels include_cycle bfs_depth3 parsed_symbols parsed_members parsed_call_sites parsed_evidence owner_sections pattern_precision makefile_evidence include_targets file_status refusals""".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{SF}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return round(float(value), 9) if isinstance(value, float) or hasattr(value, "as_tuple") else value


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, tables, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    sql = tables.sql(entry.oracle_sql()[name])
    order = [sql.columns.index(c) for c in columns]
    assert sorted(sql.columns) == columns
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in sql.fetchall())
