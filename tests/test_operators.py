import pytest
from pyspark.sql import functions as F

from codestrata.functions.owners import CATCH_ALL_NAME
from codestrata.operators import audit, calls, docs, graph, listing, ownership, paths, resolution, structures, targets, text


@pytest.fixture(scope="module")
def shared(spark):
    """Two co-claiming sections, a third and the catch-all over four files."""
    files = spark.createDataFrame([(1, "a/one.c"), (2, "a/two.c"), (3, "b/three.c"), (4, "c/four.c")], "id long, path string")
    sections = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, CATCH_ALL_NAME)], "id long, name string")
    claims = [(1, 1, 10), (1, 4, -1000), (2, 1, 10), (2, 2, 5), (2, 4, -1000), (3, 2, 10), (3, 1, 5), (3, 4, -1000), (4, 3, 10), (4, 4, -1000)]
    claims = paths.rank_claims(spark.createDataFrame(claims, "ref_id long, subsystem_id long, score long"), sections)
    symbols = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (4, 4), (5, 3), (6, 1)], "id long, file_id long")
    rows = [(1, "b_three", 2, "unique_global"), (3, "c_four", 4, "unique_global"), (5, "a_target", 6, "unique_global"), (1, "a_two", 3, "same_file"), (1, "unknown", None, "unresolved")]
    edges = spark.createDataFrame(rows, "caller_id long, callee string, callee_id long, resolution string")
    return files, sections, claims, symbols, edges


def test_overlap(shared):
    _, sections, claims, _, _ = shared
    sized = paths.section_counts(claims, sections)
    row = ownership.overlaps(claims, sized, 1).collect()
    assert [(r["name"], r["shared"]) for r in row] == [("B", 2)]
    assert row[0]["coverage"] == pytest.approx(2 / 3) and row[0]["other_coverage"] == 1.0 and row[0]["jaccard"] == pytest.approx(2 / 3)


def test_flows(shared):
    _, sections, claims, symbols, edges = shared
    got = lambda d, **k: [(r["subsystem"], r["edges"], r["internal"]) for r in calls.flows(edges, symbols, claims, sections, 1, d, **k).collect()]
    assert got("outgoing") == [("B", 1, False), ("C", 1, False)] and got("incoming") == [("B", 1, False)]
    assert ("A", 1, True) in got("outgoing", include_internal=True)
    with pytest.raises(ValueError):
        got("sideways")


def test_co_owned_files_make_no_flow(spark, shared):
    _, sections, _, symbols, edges = shared
    claims = paths.rank_claims(spark.createDataFrame([(1, 1, 9), (1, 2, 9), (3, 2, 9)], "ref_id long, subsystem_id long, score long"), sections)
    only = edges.filter("callee = 'b_three'")
    assert calls.flows(only, symbols, claims, sections, 1, "outgoing").count() == 0


def test_unowned_is_unclassified(spark, shared):
    _, sections, _, symbols, edges = shared
    claims = paths.rank_claims(spark.createDataFrame([(1, 1, 9)], "ref_id long, subsystem_id long, score long"), sections)
    rows = calls.flows(edges, symbols, claims, sections, 1, "outgoing").collect()
    assert [(r["subsystem"], r["unclassified"], r["edges"]) for r in rows] == [(None, True, 2)]


def test_coverage(shared):
    _, _, claims, symbols, edges = shared
    row = calls.coverage(edges, symbols, claims, 1).first()
    assert (row["same_file"], row["unique_global"], row["unresolved"], row["resolved"], row["total"]) == (1, 2 - 1 + 1, 1, 3, 4)


def test_pattern_join(spark):
    files = spark.createDataFrame(list(enumerate(["fs/ext4/inode.c", "fs/ext4/sub/x.c", "fs/ext2/a.c", "drivers/net/a.c", "drivers/net/v/imx.c", "README"])), "id long, path string")
    sections = [
        {"id": 0, "files": ["fs/ext4/"], "excludes": ["fs/ext4/sub/"]},
        {"id": 1, "files": ["fs/"]},
        {"id": 2, "files": ["drivers/net/*"], "regexes": ["imx"]},
        {"id": 3, "files": ["*", "*/"]},
        {"id": 4, "files": ["drivers/net/v"]},
    ]
    got = {(r["ref_id"], r["subsystem_id"]): r["score"] for r in ownership.match_sections(spark, files, sections, {"drivers/net/v"}).collect()}
    assert (0, 0) in got and (1, 0) not in got and (0, 1) in got and (3, 2) in got and (4, 2) in got and (4, 4) in got
    assert got[(5, 3)] == -1000 and got[(0, 0)] > got[(0, 1)] > got[(0, 3)]
    plan = ownership.match_sections(spark, files, sections)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


@pytest.fixture(scope="module")
def explored(spark):
    files = spark.createDataFrame([(1, "one.c"), (2, "two.c")], "id long, path string")
    symbols = spark.createDataFrame([(1, "start", 1, 1), (2, "left", 1, 10), (3, "right", 1, 20), (4, "end", 1, 30), (5, "end", 2, 1), (6, "deep", 1, 40)], "id long, name string, file_id long, start_line int")
    rows = [(1, "left", 2, 1, 0, 0), (1, "right", 3, 1, 0, 0), (2, "deep", 6, 1, 0, 0), (3, "end", 4, 2, 1, 0), (6, "end", 4, 1, 0, 0), (4, "start", 1, 1, 0, 0)]
    rows = [(a, n, b, "same_file", *c) for a, n, b, *c in rows] + [(1, "unknown", None, "ambiguous", 1, 0, 0)]
    edges = spark.createDataFrame(rows, "caller_id long, callee string, callee_id long, resolution string, direct_count long, indirect_count long, macro_count long")
    return edges, symbols, files


def test_explore(explored):
    edges, symbols, files = explored
    near = graph.adjacency(edges, symbols, files)
    assert graph.explore(near, 1, 5, to_id=4).path == [1, 3, 4]
    assert graph.explore(near, 1, 5, to_id=5).path is None and graph.explore(near, 1, 5, to_id=1).path == [1]
    full = graph.explore(near, 1, 5)
    assert len(full.nodes) == 5 and full.cycle and {b["reason"] for b in full.boundary} == {"ambiguous", "non_direct_occurrences"}
    assert not graph.explore(graph.adjacency(edges.filter("caller_id != 4"), symbols, files), 1, 5).cycle
    short = graph.explore(near, 1, 1)
    assert set(short.nodes) == {1, 2, 3} and short.truncated == ["depth_limit"]
    assert graph.explore(near, 1, 5, max_nodes=2).truncated == ["node_limit"]
    assert set(graph.explore(graph.adjacency(edges, symbols, files, incoming=True), 4, 1).nodes) == {4, 3, 6}
    with pytest.raises(ValueError):
        graph.explore(near, 1, 65)


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    got = graph.closure(spark.createDataFrame([(1, 1)], "start long, node long"), edges)
    assert sorted(r["node"] for r in got.collect()) == [1, 2, 3]
    assert sorted(r["node"] for r in graph.on_cycle(edges).collect()) == [1, 2, 3]
    assert graph.on_cycle(edges.filter("src = 4")).count() == 0
    assert graph.has_cycle([(1, 2), (2, 1)]) and not graph.has_cycle([(1, 2), (1, 3), (2, 3)])


def _resolve(spark, files, symbols, called, includes=(), domains=None):
    """called: (symbol name of the caller, callee). Returns {(caller file, callee): (resolution, callee file)}."""
    ids = {p: i for i, p in enumerate(files)}
    f = spark.createDataFrame([(i, p, "." + p.rsplit(".", 1)[1], (domains or {}).get(p, "kernel")) for p, i in ids.items()], "id long, path string, ext string, call_domain string")
    s = spark.createDataFrame([(k, ids[p], n, kind, static, 1, 9) for k, (p, n, kind, static) in enumerate(symbols)], "id long, file_id long, name string, kind string, is_static boolean, start_line int, end_line int")
    of = {(p, n): k for k, (p, n, _, _) in enumerate(symbols)}
    c = spark.createDataFrame([(of[a], b, None, "unresolved", 1, 0, 0) for a, b in called], "caller_id long, callee string, callee_id long, resolution string, direct_count long, indirect_count long, macro_count long")
    i = spark.createDataFrame([(ids[a], ids[b], 1) for a, b in includes], "includer_id long, included_id long, line int")
    back = {k: symbols[k][0] for k in range(len(symbols))}
    rows = resolution.resolve(f, s, i, c).collect()
    path = {v: k for k, v in ids.items()}
    return {(path[r["caller_file_id"]], r["name"]): (r["resolution"], back.get(r["callee_id"])) for r in rows}


def test_conservative_identities(spark):
    a, b, c, h = "one/a.c", "two/b.c", "three/c.c", "blockers.h"
    symbols = [(a, "caller", "function", False), (a, "helper", "function", True), (b, "helper", "function", True), (b, "unique", "function", False), (b, "duplicate", "function", False), (c, "duplicate", "function", False), (a, "local_duplicate", "function", True), (a, "local_duplicate", "function", True), (h, "macro_only", "macro", False)]
    got = _resolve(spark, [a, b, c, h], symbols, [((a, "caller"), n) for n in ("helper", "unique", "duplicate", "local_duplicate", "macro_only", "missing")])
    assert {n: got[(a, n)] for n in ("helper", "unique", "duplicate", "local_duplicate", "macro_only", "missing")} == {"helper": ("same_file", a), "unique": ("unique_global", b), "duplicate": ("ambiguous", None), "local_duplicate": ("ambiguous", None), "macro_only": ("macro", None), "missing": ("unresolved", None)}


def test_domains_and_blockers(spark):
    k, k2, arm, alpha, tool, head = "kernel/a.c", "drivers/b.c", "arch/arm/c.c", "arch/alpha/d.c", "tools/t.c", "include/x.h"
    symbols = [
        (k, "caller", "function", False), (arm, "arm_caller", "function", False), (tool, "tool_caller", "function", False), (head, "spin_lock", "macro", False), (tool, "spin_lock", "function", False),
        (tool, "tool_only", "function", False), (head, "inline_only", "function", True), (head, "callback", "variable", False), (k2, "conflicted", "function", False), (head, "conflicted", "macro", False),
        (k2, "device_add", "function", False), (k2, "csum_partial", "function", False), (alpha, "csum_partial", "function", False), (alpha, "alpha_only", "function", False), (k2, "generic_ok", "function", False), (tool, "accounting_local", "function", True),
    ]
    called = [((k, "caller"), n) for n in ("spin_lock", "tool_only", "inline_only", "callback", "conflicted", "device_add", "csum_partial")]
    called += [((arm, "arm_caller"), n) for n in ("alpha_only", "generic_ok")] + [((tool, "tool_caller"), n) for n in ("device_add", "accounting_local")]
    got = {key: v[0] for key, v in _resolve(spark, [k, k2, arm, alpha, tool, head], symbols, called).items()}
    assert got == {
        (k, "spin_lock"): "macro", (k, "tool_only"): "unresolved", (k, "inline_only"): "ambiguous", (k, "callback"): "ambiguous", (k, "conflicted"): "ambiguous", (k, "device_add"): "unique_global",
        (k, "csum_partial"): "ambiguous", (arm, "alpha_only"): "unresolved", (arm, "generic_ok"): "unique_global", (tool, "device_add"): "unresolved", (tool, "accounting_local"): "same_file",
    }


def test_units_must_agree(spark):
    a, b, part = "k/a.c", "k/b.c", "k/part.c"
    symbols = [(part, "caller", "function", True), (a, "target", "function", True), (b, "other", "function", False)]
    one = _resolve(spark, [a, b, part], symbols, [((part, "caller"), "target")], [(a, part)])
    two = _resolve(spark, [a, b, part], symbols, [((part, "caller"), "target")], [(a, part), (b, part)])
    assert one[(part, "target")] == ("included_source", a) and two[(part, "target")] == ("ambiguous", None)


def test_literal_subtrees(spark):
    names = ["Area", "area", "a[bc]*?_%", "abcXYZ"]
    files = spark.createDataFrame([(i, f"{d}/unit.c") for i, d in enumerate(names)], "id long, path string")
    for i, d in enumerate(names):
        assert [r["id"] for r in files.filter(paths.under(F.col("path"), d)).collect()] == [i]
    dirs = paths.directories(files)
    assert listing.directory_entries(dirs.join(paths.directory_counts(files), "path")).count() == 4  # the root is hidden


def test_breadth_first_ids(spark):
    files = spark.createDataFrame([(i, p) for i, p in enumerate(["a/x/1.c", "a-x/1.c", "b/1.c", "1.c"])], "id long, path string")
    assert [r["path"] for r in paths.directories(files).orderBy("id").collect()] == ["", "a", "a-x", "b", "a/x"]


@pytest.fixture(scope="module")
def named(spark):
    files = spark.createDataFrame([(1, "fs/open.c", "open.c"), (2, "tools/open.c", "open.c"), (3, "include/open.h", "open.h")], "id long, path string, name string").withColumn("size", F.lit(1)).withColumn("lines", F.lit(1))
    dirs = paths.directories(files).join(paths.directory_counts(files), "path")
    rows = [(1, 1, "do_open", "function", 10, 30, False), (2, 2, "do_open", "function", 1, 5, False), (3, 3, "do_open", "prototype", 4, 4, False), (4, 1, "inner", "function", 15, 18, True), (5, 1, "fs", "variable", 1, 1, True)]
    symbols = spark.createDataFrame(rows, "id long, file_id long, name string, kind string, start_line int, end_line int, is_static boolean").withColumn("is_exported", F.lit(False))
    return dirs, files, symbols


def test_resolution_tiers(named):
    dirs, files, symbols = named
    go = lambda spec: targets.resolve(spec, dirs, files, symbols)
    assert go("").target["path"] == "" and go("fs/").target["kind"] == "dir" and go("fs/open.c").target["kind"] == "file"
    assert go("do_open").target["id"] == 1 and [c["id"] for c in go("do_open").candidates] == [2, 3] and "3 candidates" in go("do_open").note
    assert go("fs/open.c:16").target["id"] == 4 and go("fs/open.c:11").target["id"] == 1 and go("fs/open.c:do_open").target["id"] == 1
    assert go("fs/open.c:99").target is None and go("nothing").target is None
    assert go("open.c").target["path"] == "fs/open.c" and go("fs").target["kind"] == "dir"
    assert targets.resolve_symbol(symbols, files, "gone").target is None


def test_suggestions(named):
    dirs, files, symbols = named
    assert [r["name"] for r in targets.suggestions("innerx", dirs, files, symbols).collect()] == ["inner"]


def test_search_modes(named):
    _, files, symbols = named
    names = lambda p, **k: [r["ref_id"] for r in listing.search(symbols, files, p, **k).collect()]
    assert names("OPEN") == [1, 3, 2] and names("DO_", mode="prefix") == [1, 3, 2] and names("DO_OPEN", mode="exact") == [] and names("i?n*", mode="glob") == [4]
    assert names("o", static="only") == [] and names("", limit=1) == [5] and names("", grep="^IN", limit=0) == [4]
    with pytest.raises(ValueError):
        listing.search(symbols, files, "x", mode="fuzzy")


def test_siblings_limit_counts_others(named):
    dirs, files, symbols = named
    entries = listing.collect(listing.build_scope("fs/open.c", "symbol"), dirs, files, symbols)
    assert {r["ref_id"] for r in listing.siblings(entries, "function", 1, limit=2).collect()} == {4, 5}
    assert listing.siblings(entries, "function", 1, limit=2, include_self=True).count() == 3
    assert listing.kinds_of(["functions", "file"]) == ["function", "syscall", "file"]
    with pytest.raises(ValueError):
        listing.kinds_of(["nope"])


DOCS = [
    ("Documentation/a.rst", "Title one\n=========\n\nThe Buffer_Head is here. buffer_head again\nbuffer_head_x no\n"),
    ("Documentation/100%/b.md", "# Heading B #\ntext buffer_head\nÉTAT\n"),
    ("Documentation/100more/c.txt", "buffer_head"),
    ("Documentation/empty.txt", ""),
]


def test_text_search(spark):
    df = spark.createDataFrame(DOCS, "path string, content string")
    hits = [(r["path"], r["line"], r["heading"]) for r in text.search(df, "buffer_head").collect()]
    assert hits == [("Documentation/100%/b.md", 2, "Heading B"), ("Documentation/100more/c.txt", 1, None), ("Documentation/a.rst", 4, "Title one"), ("Documentation/a.rst", 5, "Title one")]
    assert len(text.search(df, "buffer_head", mention=True).collect()) == 3
    assert text.search(df, "état").count() == 1
    assert [r["path"] for r in text.search(df, "buffer_head", scope=paths.under(F.col("path"), "Documentation/100%")).collect()] == ["Documentation/100%/b.md"]
    assert text.search(df, "buffer_head", limit=1).count() == 1
    with pytest.raises(ValueError):
        text.search(df, "")


def test_contract_hits_come_last(spark):
    df = spark.createDataFrame(DOCS, "path string, content string")
    files = spark.createDataFrame([(1, "code.c")], "id long, path string")
    symbols = spark.createDataFrame([(7, 1, "f")], "id long, file_id long, name string")
    contract = spark.createDataFrame([(7, 10, "about buffer_head", [("p", "x")], "", None, "")], "symbol_id long, line int, summary string, parameters array<struct<name:string,text:string>>, description string, context string, returns string")
    rows = text.search(df, "buffer_head", contracts=text.contract_texts(contract, symbols, files)).collect()
    assert rows[-1]["source_kind"] == "contract" and rows[-1]["heading"] == "summary"
    assert text.contract(contract, symbols, 7).first()["description"] is None


def test_frames(spark):
    trace = "Call Trace:\n <TASK>\n tcp_sendmsg+0x1a/0x40 [ipv6]\n foo.isra.0\n#3  0xff in bar (x=1)\nbaz\ntwo words\n </TASK>"
    rows = text.frames(spark.createDataFrame([(1, trace)], "id long, text string")).orderBy("line", "nth").collect()
    assert [r["frame"] for r in rows] == ["tcp_sendmsg", "foo", "bar", "baz"]


def test_doc_rank(spark):
    rows = [(f"Documentation/{p}", p.rsplit("/", 1)[-1], 1, 1) for p in ("filesystems/ext4.rst", "filesystems/index.rst", "networking/tcp.rst", "bindings/ext4.yaml")]
    df = spark.createDataFrame(rows, "path string, name string, size long, lines long")
    got = [(r["path"], r["tier"]) for r in docs.rank(docs.Study("fs/ext4/inode.c", "file", declarations=["ext4_get"]), df).collect()]
    assert got == []
    got = [r["path"] for r in docs.rank(docs.Study("fs/ext4", "dir"), df).collect()]
    assert got[0] == "Documentation/bindings/ext4.yaml" or got[0] == "Documentation/filesystems/ext4.rst"
    assert "Documentation/filesystems/index.rst" in got and "Documentation/networking/tcp.rst" not in got
    assert docs.rank(docs.Study("Documentation/networking/tcp.rst", "file"), df).first()["tier"] == 0


def test_type_relationships(spark):
    files = spark.createDataFrame([(1, "packet.h", ".h"), (2, "duplicate.h", ".h"), (3, "users.c", ".c"), (4, "private.c", ".c")], "id long, path string, ext string")
    symbols = spark.createDataFrame([(1, 1, "packet", "struct", 1, 5), (2, 2, "packet", "struct", 1, 5), (3, 4, "packet", "struct", 1, 5), (4, 3, "f", "function", 1, 20)], "id long, file_id long, name string, kind string, start_line int, end_line int")
    aliases = spark.createDataFrame([(1, "packet_t")], "symbol_id long, name string")
    refs = spark.createDataFrame([(3, 5, 9, "struct", "packet", "pointer_member"), (4, 8, 9, "struct", "packet", "embedded_member"), (3, 6, 9, "typedef", "packet_t", "embedded_member")], "file_id long, line int, owner_id long, kind string, name string, role string")
    got = sorted((r["file_id"], r["name"], r["target_id"], r["ambiguous"]) for r in structures.relationships(refs, symbols, aliases, files).collect())
    assert got == [(3, "packet", 1, True), (3, "packet", 2, True), (3, "packet_t", 1, False), (4, "packet", 3, False)]


def test_audit(spark, shared):
    files, sections, claims, _, _ = shared
    owners = paths.directory_owners(files, claims, sections, CATCH_ALL_NAME)
    good = audit.ownership(files, claims, sections, owners, CATCH_ALL_NAME)
    assert {r["check"]: r["n"] for r in audit.violations(good).collect()} == {k: 0 for k in good}
    bad = claims.withColumn("rank", F.when(F.col("ref_id") == 2, 5).otherwise(F.col("rank")))
    assert audit.ownership(files, bad, sections, owners, CATCH_ALL_NAME)["claim_rank"].count() == 2 + 1
    assert audit.ownership(files, claims, sections, owners.filter("path != 'a'"), CATCH_ALL_NAME)["rollup"].count() > 0
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 9), (4, 4)], "includer_id long, included_id long")
    found = {k: df.count() for k, df in audit.includes(edges, files).items()}
    assert found == {"includer": 0, "included": 1, "self": 1, "cycle": 3}
    sites = spark.createDataFrame([(1, "f", "direct", 3, 0)], "caller_id long, callee string, kind string, line int, byte_offset long")
    counted = calls.grouped_occurrences(sites)
    assert audit.site_counts(sites, counted).count() == 0 and audit.site_counts(sites, counted.withColumn("direct_count", F.lit(2))).count() == 1


def test_directory_labels(spark):
    sections = spark.createDataFrame([(1, "A"), (2, "B"), (4, CATCH_ALL_NAME)], "id long, name string")
    files = spark.createDataFrame([(1, "fs/a.c"), (2, "fs/b.c"), (3, "x/a.c"), (4, "x/b.c"), (5, "y/a.c"), (6, "z/a.c")], "id long, path string")
    claims = paths.rank_claims(spark.createDataFrame([(1, 1, 5), (2, 2, 5), (3, 1, 5), (5, 2, 5), (6, 4, -1000)], "ref_id long, subsystem_id long, score long"), sections)
    owners = paths.directory_owners(files, claims, sections, CATCH_ALL_NAME)
    got = {r["path"]: r["label"] for r in ownership.directory_labels(owners, sections, ownership.unclaimed_counts(files, claims), paths.directories(files).select("path")).collect()}
    assert got["fs"] == "Filesystems (mixed)" and got["x"] == "Mixed (1 subsystem + unclassified)" and got["y"] == "B" and got["z"] is None and got[""].startswith("Mixed (2 subsystems")


def test_search_gives_all_hits_unless_limited(spark):
    df = spark.createDataFrame([(f"Documentation/src0/{k}.txt", "\n".join(["The license, version 2"] * 3000)) for k in range(2)], "path string, content string")
    assert text.search(df, "License, Version", limit=None).count() == 6000
    assert text.search(df, "license").count() == text.search(df, "license", limit=9000).count() == text.MOST_HITS


@pytest.mark.parametrize("name", ["text_search", "text_in_scope"])
def test_registered_searches_give_all_hits(spark, tmp_path, name):
    import __spark_entry__ as entry

    spark.createDataFrame([(k, "\n".join(["The license, version 2"] * 3000), "en", "src0", 9) for k in range(2)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert entry.queries()[name](spark, str(tmp_path)).count() == 6000


def test_contract_hits_gives_all_hits(spark, tmp_path):
    import __spark_entry__ as entry

    n = 3000
    spark.range(n).selectExpr("id AS p_partkey", "'red bolt' AS p_name", "'Brand#11' AS p_brand", "'PROMO' AS p_type", "3 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    spark.range(2 * n).selectExpr("id DIV 2 AS conv_id", "CAST(id % 2 AS INT) AS turn", "'about the bolt' AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert entry.queries()["contract_hits"](spark, str(tmp_path)).count() == 2 * n


def test_section_of_part_of_several_names(spark):
    from codestrata.operators import reports

    names = ["Part 11", *[f"Part 11{k}" for k in range(60)], "Part 12", "Other 12"]
    counts = spark.createDataFrame([(k, n, k, 0) for k, n in enumerate(names)], "id long, name string, n_files long, n_primary_files long")
    dirs = spark.createDataFrame([], "id long, path string, parent_id long, name string, depth int")
    files = spark.createDataFrame([], "id long, path string, name string")
    symbols = spark.createDataFrame([], "id long, file_id long, name string, kind string, start_line int, end_line int, is_static boolean")
    claims = spark.createDataFrame([], "ref_id long, subsystem_id long, is_primary boolean")
    section = lambda spec: reports.section_of(spec, counts, dirs, files, symbols, claims)
    assert section("t 11") == 0 and section("T 1159") == 60  # 61 names hold "t 11", one ends with it
    assert section(" 12") is None and section("Part") is None and section("none") is None


def test_shortest_path_beyond_the_budgets(spark):
    """0 calls 3,000 nodes, each of which calls 4,000; the admission order decides between equals."""
    edges = [(0, k, f"n{k:05}") for k in range(1, 3001)] + [(k, 4000, "x") for k in range(1, 3001)] + [(4000, 5000, "y"), (9, 4000, "a"), (5000, 6000, "z")]
    df = spark.createDataFrame(edges, "src long, dst long, callee string")
    rows = lambda *a: sorted(tuple(r) for r in graph.shortest_path(df, *a).collect())
    assert rows(0, 5000, 3) == [(0, 0), (1, 1), (2, 4000), (3, 5000)]
    assert rows(0, 6000, 3) == rows(0, 0, 3) == rows(0, 77777, 9) == [(0, 0)]
    assert rows(0, 6000, 4)[-1] == (4, 6000)


def test_usage_counts_relationships(spark):
    files = spark.createDataFrame([(k, f"f{k}", ".h" if k < 6 else ".c") for k in range(12)], "id long, path string, ext string")
    symbols = spark.createDataFrame([(k, k % 12, f"n{k % 3}", "struct", 2, 5) for k in range(60)] + [(99, 7, "f", "function", 1, 9)], "id long, file_id long, name string, kind string, start_line int, end_line int")
    aliases = spark.createDataFrame([(k, f"t{k % 2}") for k in range(60)] + [(0, "t0")], "symbol_id long, name string")
    refs = spark.createDataFrame([(f, f, 7, kind, f"{kind[0].replace('s', 'n')}{k}", role) for f in range(14) for k in range(3) for kind in ("struct", "typedef") for role in ("a", "b", None)] * 2, "file_id long, line int, owner_id long, kind string, name string, role string")
    for cap in (100, 4):
        rows = structures.relationships(refs, symbols, aliases, files, cap).groupBy("target_id", "role").agg(F.count("*").alias("n"), F.count_if("ambiguous").alias("ambiguous"))
        want = {(r["target_id"], r["role"]): (r["n"], r["ambiguous"]) for r in rows.collect()}
        assert want == {(r["target_id"], r["role"]): (r["n"], r["ambiguous"]) for r in structures.usage(refs, symbols, aliases, files, cap).collect()}
        one = {r["role"]: (r["n"], r["ambiguous"]) for r in structures.used_by(3, refs, symbols, aliases, files, cap).collect()}
        assert len(want) > 10 and one == {role: x for (t, role), x in want.items() if t == 3}


def _crowd(spark):
    """150 headers and one source file, each with a packet and a packet_t; references from files with and without one."""
    files = spark.createDataFrame([(k, f"f{k}", ".h") for k in range(150)] + [(200, "own.c", ".c"), (201, "user.c", ".c")], "id long, path string, ext string")
    symbols = spark.createDataFrame([(k, k, "packet", "struct", 1, 5) for k in range(150)] + [(1000 + k, 200, "packet", "struct", 1, 5) for k in range(120)], "id long, file_id long, name string, kind string, start_line int, end_line int")
    aliases = spark.createDataFrame([(k, "packet_t") for k in range(150)], "symbol_id long, name string")
    refs = spark.createDataFrame([(201, 5, 9, "struct", "packet", "a"), (201, 6, 9, "struct", "packet", "a"), (200, 7, 9, "typedef", "packet_t", "b"), (200, 8, 9, "struct", "packet", "b")] * 2, "file_id long, line int, owner_id long, kind string, name string, role string")
    return refs, symbols, aliases, files


def test_used_by_looks_past_a_hundred_candidates(spark):
    """structure_report's part: also the last of many namesakes, in headers or in one file, has its references."""
    one = lambda k: sorted(tuple(r) for r in structures.used_by(k, *_crowd(spark)).collect())
    assert one(0) == one(99) == one(100) == one(149) == [("a", 2, 2), ("b", 1, 1)]
    assert one(1000) == one(1119) == [("b", 1, 1)]


def test_usage_looks_past_a_hundred_candidates(spark):
    """structure_usage's part: every reference counts for each of its 150 or 120 candidates."""
    got = {(r["target_id"], r["role"]): (r["n"], r["ambiguous"]) for r in structures.usage(*_crowd(spark)).collect()}
    want = {(k, "a"): (2, 2) for k in range(150)} | {(k, "b"): (1, 1) for k in range(150)} | {(1000 + k, "b"): (1, 1) for k in range(120)}
    assert got == want


def test_references_without_comparing_all_pairs(spark, tmp_path):
    """The adapter's references are those of the SQL both engines share, by equality joins."""
    from codestrata.plans import adapter

    spark.range(3000).selectExpr("id AS p_partkey", "'red bolt' AS p_name", "'Brand#11' AS p_brand", "'PROMO' AS p_type", "CAST(id * 7 % 50 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    got = adapter.spark_table(spark, str(tmp_path), "k_references")
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    want = spark.sql(adapter.SQL["k_references"], k_symbols=adapter.spark_table(spark, str(tmp_path), "k_symbols"))
    assert want.count() > 300 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
