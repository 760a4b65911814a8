"""Further registered queries and their SQL twins: ownership rules, orders, cards, structures, domains, texts and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions import links
from codestrata.functions import text as strings
from codestrata.functions.owners import compile_rules
from codestrata.operators import audit, calls, docs, graph, listing, ownership, paths, reports, resolution, structures, targets, text
from codestrata.plans.adapter import CATCH_ALL
from codestrata.plans.catalogue import _AREA, _CALLS, _FLOW, _LINES, _RANK, _RESOLVE, BELOW, CLAIMS, ENTRY_SYMBOLS, ORACLES, OWN, SECTION, Tables, query
from codestrata.sources import sinks

# Ownership rules: the patterns, and in SQL what each means, spelled out.

RULES = [
    {"id": 1, "name": "CORE", "files": ["kernel/"], "excludes": ["kernel/brand_11/"]},
    {"id": 2, "name": "ARM", "files": ["arch/arm/", "arch/*/brand_2?/"]},
    {"id": 3, "name": "DRIVERS", "files": ["drivers/*/", "drivers/brand_13/*.h"]},
    {"id": 4, "name": "BOLTS", "regexes": ["bolt_[0-9]*7"]},
    {"id": 5, "name": "FS", "files": ["fs/brand_3*/*.c", "fs/**/red_*"], "excludes": ["fs/brand_31/*.c"]},
    {"id": 6, "name": "THREES", "files": ["kernel/brand_3[12]/"]},
    {"id": 7, "name": "BROKEN", "files": ["x[", ""], "regexes": ["("]},
]
_MATCH = r"""hits AS (
  SELECT id, 1 AS s, 27 AS score, FALSE AS out FROM k_files WHERE path LIKE 'kernel/%' UNION ALL SELECT id, 1, NULL, TRUE FROM k_files WHERE path LIKE 'kernel/brand\_11/%' ESCAPE '\'
  UNION ALL SELECT id, 2, 49, FALSE FROM k_files WHERE path LIKE 'arch/arm/%' UNION ALL SELECT id, 2, 39, FALSE FROM k_files WHERE regexp_matches(path, '^arch/.*/brand_2./')
  UNION ALL SELECT id, 3, 28, FALSE FROM k_files WHERE regexp_matches(path, '^drivers/.*/') UNION ALL SELECT id, 3, 61, FALSE FROM k_files WHERE regexp_matches(path, '^drivers/brand_13/[^/]*\.h') AND len(path) - len(replace(path, '/', '')) = 2
  UNION ALL SELECT id, 4, 40, FALSE FROM k_files WHERE regexp_matches(path, 'bolt_[0-9]*7')
  UNION ALL SELECT id, 5, 34, FALSE FROM k_files WHERE regexp_matches(path, '^fs/brand_3.*/.*\.c') AND len(path) - len(replace(path, '/', '')) = 2 UNION ALL SELECT id, 5, 31, FALSE FROM k_files WHERE regexp_matches(path, '^fs/.*/red_')
  UNION ALL SELECT id, 5, NULL, TRUE FROM k_files WHERE regexp_matches(path, '^fs/brand_31/.*\.c') AND len(path) - len(replace(path, '/', '')) = 2
  UNION ALL SELECT id, 6, 37, FALSE FROM k_files WHERE regexp_matches(path, '^kernel/brand_3[12]/')),
 matched AS (SELECT id AS ref_id, s AS subsystem_id, max(score) AS score FROM hits GROUP BY 1, 2 HAVING NOT bool_or(out))"""
_NAMED = "named AS (SELECT m.*, n.name FROM matched m JOIN (VALUES " + ", ".join(f"({r['id']}, '{r['name']}')" for r in RULES) + ") n(id, name) ON n.id = m.subsystem_id)"


def _rule_claims(t: Tables) -> tuple[DataFrame, DataFrame]:
    sections = t.spark.createDataFrame([(r["id"], r["name"]) for r in RULES], "id long, name string")
    return paths.rank_claims(ownership.match_rules(t.files, compile_rules(RULES)), sections), sections


@query(f"{_MATCH} SELECT ref_id, CAST(subsystem_id AS BIGINT) AS subsystem_id, CAST(score AS BIGINT) AS score FROM matched", "k_files")
def ownership_match(t: Tables) -> DataFrame:
    return ownership.match_rules(t.files, compile_rules(RULES))


@query(f"{_MATCH}, {_NAMED} SELECT ref_id, CAST(subsystem_id AS BIGINT) AS subsystem_id, CAST(score AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, name, subsystem_id) - 1 AS INT) AS rank, score = max(score) OVER (PARTITION BY ref_id) AS is_primary FROM named", "k_files")
def ownership_match_rank(t: Tables) -> DataFrame:
    return _rule_claims(t)[0]


@query(f"{_MATCH} SELECT f.id, f.path FROM k_files f WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.ref_id = f.id)", "k_files")
def unclaimed_files(t: Tables) -> DataFrame:
    """Files that no ownership rule gives an owner."""
    return ownership.unclaimed(t.files, _rule_claims(t)[0]).select("id", "path")


@query(f"{CLAIMS} SELECT name, score, rank, is_primary FROM claims WHERE ref_id = 30", OWN)
def owners_of_path(t: Tables) -> DataFrame:
    return ownership.of_path(t.claims, t.sections, 30)


@query(f"""{CLAIMS}, {BELOW}, total AS (SELECT path, count(*) AS total FROM below GROUP BY 1)
 SELECT b.path, count(*) AS n_claimed, count(*) FILTER (WHERE is_primary) AS n_primary, count(*) FILTER (WHERE is_primary) / any_value(total)::DOUBLE AS coverage, CASE WHEN b.path = '' THEN 0 ELSE CAST(len(string_split(b.path, '/')) AS INT) END AS depth
 FROM below b JOIN claims c ON c.ref_id = b.id JOIN total t ON t.path = b.path WHERE c.subsystem_id = {SECTION} GROUP BY b.path ORDER BY n_primary DESC, coverage DESC, depth DESC, b.path LIMIT 25""", OWN)
def section_directories(t: Tables) -> DataFrame:
    """The top of one section's directories, in their order."""
    return ownership.section_directories(paths.directory_owners(t.files, t.claims, t.sections, CATCH_ALL), SECTION).limit(25)


@query(f"{BELOW}, lab AS ({ORACLES['directory_labels']}) SELECT b.id, CAST(b.k AS INT) AS depth, b.path, lab.label FROM below b LEFT JOIN lab ON lab.path = b.path", "k_files")
def ancestry_labels(t: Tables) -> DataFrame:
    """Every file's directories with their labels."""
    owners = paths.directory_owners(t.files, t.claims, t.sections, CATCH_ALL)
    labels = ownership.directory_labels(owners, t.sections, ownership.unclaimed_counts(t.files, t.claims), t.dirs.select("path"), CATCH_ALL)
    return ownership.ancestry(t.files.select("id", "path"), labels)


_SECTION_SORTS = {"size": "n_primary_files DESC, n_files DESC, name", "claimed": "n_files DESC, name", "primary": "n_primary_files DESC, name", "name": "name"}


@query(f"{CLAIMS}, n AS (SELECT s.id, s.name, count(c.ref_id) AS n_files, count(c.ref_id) FILTER (WHERE c.is_primary) AS n_primary_files FROM k_sections s LEFT JOIN claims c ON c.subsystem_id = s.id GROUP BY 1, 2) " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS sort, id, name, n_files, n_primary_files FROM n ORDER BY {v} LIMIT 12)" for k, v in _SECTION_SORTS.items()), OWN)
def subsystem_sorts(t: Tables) -> DataFrame:
    """The first twelve sections by each order."""
    parts = [ownership.section_list(t.sized_sections, k).limit(12).select(F.lit(k).alias("sort"), "id", "name", "n_files", "n_primary_files") for k in _SECTION_SORTS]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"""{CLAIMS}, {ENTRY_SYMBOLS}, mine AS (SELECT ref_id FROM claims WHERE subsystem_id = {SECTION}), f AS (SELECT f.* FROM k_files f WHERE f.id IN (SELECT ref_id FROM mine)), {BELOW.replace("FROM k_files)", "FROM f)")}
 SELECT 'file' AS kind, path, name FROM f UNION ALL SELECT DISTINCT 'dir', path, string_split(path, '/')[-1] FROM below WHERE path <> '' UNION ALL SELECT kind, path, name FROM entries WHERE path IN (SELECT path FROM f) AND kind <> 'prototype'""", "k_symbols " + OWN)
def scope_section(t: Tables) -> DataFrame:
    """All that one section claims."""
    scope = listing.section_scope("", SECTION, t.dirs, t.files, t.claims)
    return listing.collect(scope, t.dirs, t.files, t.symbols).select("kind", "path", "name")


# Listings.

_ENTRIES = f"""{BELOW}, de AS (SELECT path, count(*) AS n FROM below GROUP BY 1), {ENTRY_SYMBOLS}, every AS (SELECT 0 AS rank, 'dir' AS kind, string_split(path, '/')[-1] AS name, path, NULL::BIGINT AS line, NULL::BIGINT AS span, NULL::BIGINT AS size, NULL::BIGINT AS lines, n AS n_files, 0 AS ref_id FROM de WHERE path <> ''
 UNION ALL SELECT 1, 'file', name, path, NULL, NULL, size, lines, NULL, id FROM k_files UNION ALL SELECT 2, kind, name, path, line, span, NULL, NULL, NULL, ref_id FROM entries),
 folded AS (SELECT *, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS fold FROM every)"""
_ORDERS = {
    "name": "fold, path, line NULLS FIRST, kind",
    "path": "path, line NULLS FIRST, kind, fold",
    "kind": "kind, fold, path, line NULLS FIRST",
    "line": "path, line NULLS FIRST, kind, fold",
    "size": "coalesce(n_files, size) DESC NULLS LAST, fold, path, line NULLS FIRST, kind",
    "lines": "coalesce(n_files, lines, span) DESC NULLS LAST, fold, path, line NULLS FIRST, kind",
}


@query(f"{_ENTRIES} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS sort, kind, name, path, CAST(row_number() OVER (PARTITION BY kind ORDER BY rank, {v}, ref_id) AS INT) AS place FROM folded) WHERE place <= 40" for k, v in _ORDERS.items()), "k_symbols k_files")
def listing_orders(t: Tables) -> DataFrame:
    """The first forty entries of each kind by each of the six orders."""
    everything = listing.collect(listing.build_scope("", "dir", "tree"), t.dirs, t.files, t.symbols)
    parts = [listing.top_per(everything, "kind", 40, k).select(F.lit(k).alias("sort"), "kind", "name", "path", F.col("at").alias("place")) for k in _ORDERS]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(f"{_ENTRIES} SELECT kind, name, path, CAST(line AS INT) AS line FROM folded WHERE kind IN ('dir', 'file', 'function') ORDER BY rank, fold, path, line NULLS FIRST, kind, ref_id LIMIT 700", "k_symbols k_files")
def merged_order(t: Tables) -> DataFrame:
    """One limit over directories, files and functions in their merged order."""
    return listing.collect(listing.build_scope("", "dir", "tree"), t.dirs, t.files, t.symbols, kinds=["dir", "file", "function"], limit=700).select("kind", "name", "path", "line")


@query(f"""{ENTRY_SYMBOLS} SELECT kind, name, CASE WHEN is_exported AND is_static THEN 'EXPORT static' WHEN is_exported THEN 'EXPORT' WHEN is_static THEN 'static' ELSE '-' END AS flags, path || ':' || line AS location, is_static AS static, span FROM entries WHERE kind IN ('struct', 'union', 'enum', 'typedef', 'function', 'syscall')""", "k_symbols k_files")
def listing_columns(t: Tables) -> DataFrame:
    """Columns of the closed vocabulary, for kinds named by alias."""
    rows = listing.search(t.symbols, t.files, "", kinds=listing.kinds_of(["types", "functions"]), limit=0)
    return listing.projected(rows, ["kind", "name", "flags", "location", "static", "span"])


@query(f"""{ENTRY_SYMBOLS} SELECT path || ':' || line || ':' || name AS value FROM entries WHERE kind = 'macro'""", "k_symbols k_files")
def plain_locations(t: Tables) -> DataFrame:
    return sinks.plain(listing.search(t.symbols, t.files, "", kinds=["macro"], limit=0))


@query(f"""{ENTRY_SYMBOLS} SELECT '{{"kind":"' || kind || '","name":"' || name || '","path":"' || path || '","line":' || line || ',"static":' || CASE WHEN is_static THEN 'true' ELSE 'false' END || '}}' AS value FROM entries WHERE kind = 'variable'""", "k_symbols k_files")
def json_entries(t: Tables) -> DataFrame:
    return sinks.json_rows(listing.projected(listing.search(t.symbols, t.files, "", kinds=["variable"], limit=0), ["kind", "name", "path", "line", "static"]))


@query("""x AS (SELECT 1) SELECT c.caller_id, c.callee, trim(CASE WHEN direct_count > 0 THEN direct_count || 'd ' ELSE '' END || CASE WHEN indirect_count > 0 THEN indirect_count || 'i ' ELSE '' END || CASE WHEN macro_count > 0 THEN macro_count || 'm' ELSE '' END) AS counts,
 CASE WHEN f.size * 4096 >= 1048576 THEN printf('%.1fM', f.size * 4096 / 1048576.0) WHEN f.size * 4096 >= 1024 THEN printf('%.1fK', f.size * 4096 / 1024.0) ELSE (f.size * 4096) || 'B' END AS size FROM k_calls c JOIN k_symbols s ON s.id = c.caller_id JOIN k_files f ON f.id = s.file_id""", "k_calls k_files")
def formatted_calls(t: Tables) -> DataFrame:
    """Counts and sizes as they are shown."""
    rows = t.calls.join(t.symbols.select(F.col("id").alias("caller_id"), F.col("file_id").alias("id")), "caller_id").join(t.files.select("id", "size"), "id")
    return rows.select("caller_id", "callee", strings.occurrences(F.col("direct_count"), F.col("indirect_count"), F.col("macro_count")).alias("counts"), strings.human_size(F.col("size") * 4096).alias("size"))


_LINKS = {"6.12.104": ("stable/linux.git", "v6.12.104"), "6.18": ("torvalds/linux.git", "v6.18"), "6.19-rc3": ("torvalds/linux.git", "v6.19-rc3"), "2.6.32.1": ("stable/linux.git", "v2.6.32.1"), "2.6.32": ("torvalds/linux.git", "v2.6.32")}


@query("x AS (SELECT 1) " + " UNION ALL ".join(f"SELECT '{v}' AS version, id, 'https://git.kernel.org/pub/scm/linux/kernel/git/{repo}/tree/' || path || '?h={tag}#n' || lines AS link FROM k_files" for v, (repo, tag) in _LINKS.items()) + " UNION ALL SELECT 'local', id, NULL FROM k_files", "k_files")
def links_by_version(t: Tables) -> DataFrame:
    """Links of stable, mainline, candidate and old releases; a tree that is no release has none."""
    parts = [t.files.select(F.lit(v).alias("version"), "id", links.source_link(v, F.col("path"), F.col("lines")).alias("link")) for v in (*_LINKS, "local")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


# Targets.

@query(f"""{ENTRY_SYMBOLS}, {BELOW}, d AS (SELECT DISTINCT path, string_split(path, '/')[-1] AS name FROM below), file AS (SELECT * FROM k_files WHERE id = 40), sym AS (SELECT * FROM entries WHERE ref_id = 31)
 SELECT 'root' AS spec, 0 AS tier, 'dir' AS kind, path, NULL AS line, 1 AS rank FROM d WHERE path = '' UNION ALL SELECT 'directory', 2, 'dir', path, NULL, 1 FROM d WHERE path = 'arch/arm'
 UNION ALL SELECT 'file', 3, 'file', path, NULL, 1 FROM file UNION ALL SELECT 'base name', 5, 'file', path, NULL, 1 FROM file
 UNION ALL SELECT 'directory name', 6, 'dir', path, NULL, row_number() OVER (ORDER BY path LIKE 'tools/%', len(path) - len(replace(path, '/', '')), length(path), path) FROM d WHERE name = 'brand_11'
 UNION ALL SELECT 'path:line', 1, 'symbol', e.path, e.line, row_number() OVER (ORDER BY e.end_line - e.line, {_RANK.replace("kind", "e.kind").replace("path", "e.path").replace("is_static", "e.is_static").replace(", line,", ", e.line,").replace("ref_id", "e.ref_id")}) FROM entries e, sym WHERE e.path = sym.path AND sym.line BETWEEN e.line AND e.end_line
 UNION ALL SELECT 'path:symbol', 1, 'symbol', e.path, e.line, row_number() OVER (ORDER BY {_RANK.replace("kind", "e.kind").replace("path", "e.path").replace("is_static", "e.is_static").replace(", line,", ", e.line,").replace("ref_id", "e.ref_id")}) FROM entries e, sym WHERE e.path = sym.path AND e.name = sym.name""", "k_symbols k_files")
def resolve_tiers(t: Tables) -> DataFrame:
    """Candidates of one spec for each tier that names a place."""
    file = t.files.filter("id = 40").first()
    sym = listing.symbol_entries(t.symbols.filter("id = 31"), t.files).first()
    specs = {"root": "/", "directory": "./arch/arm/", "file": file["path"], "base name": file["name"], "directory name": "brand_11", "path:line": f"{sym['path']}:{sym['line']}", "path:symbol": f"{sym['path']}:{sym['name']}"}
    parts = [targets.candidates(s, t.dirs, t.files, t.symbols).select(F.lit(k).alias("spec"), "tier", "kind", "path", "line", "rank") for k, s in specs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query(f"""{BELOW}, d AS (SELECT DISTINCT path FROM below) SELECT 'arch/x86' AS spec, path FROM d WHERE path = 'arch/x86' UNION ALL SELECT 'brand_11', path FROM d WHERE path = 'kernel/brand_11' UNION ALL SELECT 'fs', path FROM d WHERE path = 'fs' UNION ALL SELECT 'nowhere', NULL""", "k_files")
def area_targets(t: Tables) -> DataFrame:
    """What areas mean: a directory, one of that name under kernel/, or nothing."""
    found = [(s, targets.resolve_area(s, t.dirs, t.files, t.symbols).target) for s in ("arch/x86", "brand_11", "fs", "nowhere")]
    return t.spark.createDataFrame([(s, r["path"] if r else None) for s, r in found], "spec string, path string")


@query(f"""{CLAIMS}, own AS (SELECT ref_id, count(*) AS n, min(subsystem_id) AS s FROM claims WHERE is_primary GROUP BY 1), one AS (SELECT f.path, own.s FROM own JOIN k_files f ON f.id = own.ref_id WHERE own.n = 1 AND own.s <> 0 ORDER BY f.id LIMIT 1)
 SELECT 'name' AS spec, CAST({SECTION} AS BIGINT) AS section UNION ALL SELECT 'folded name', {SECTION} UNION ALL SELECT 'file', s FROM one UNION ALL SELECT 'mixed directory', NULL UNION ALL SELECT 'part of a name', 11""", OWN)
def sections_meant(t: Tables) -> DataFrame:
    """The section that a name, its other case, a part of it, a file and a mixed directory mean."""
    counts = t.sized_sections
    alone = t.claims.filter("is_primary").groupBy("ref_id").agg(F.count("*").alias("n"), F.min("subsystem_id").alias("s")).filter("n = 1 and s != 0")
    file = t.files.join(alone, F.col("id") == F.col("ref_id")).orderBy("id").first()["path"]
    name = t.sections.filter(F.col("id") == SECTION).first()["name"]
    specs = {"name": name, "folded name": name.upper(), "file": file, "mixed directory": "arch", "part of a name": "000011"}
    rows = [(k, reports.section_of(s, counts, t.dirs, t.files, t.symbols, t.claims, CATCH_ALL)) for k, s in specs.items()]
    return t.spark.createDataFrame(rows, "spec string, section long")


@query(f"""{CLAIMS}, {BELOW}, c AS (SELECT count(*) FILTER (WHERE k = n - 1) AS direct, count(*) AS total FROM below WHERE path = 'arch/arm'), per AS (SELECT c.name, count(*) AS n_claimed, count(*) FILTER (WHERE is_primary) AS n_primary FROM below b JOIN claims c ON c.ref_id = b.id WHERE b.path = 'arch/arm' GROUP BY 1),
 s AS (SELECT * FROM k_symbols WHERE file_id = 30)
 SELECT 'directory owner' AS part, name, n_primary AS n FROM per UNION ALL SELECT 'directory count', 'n_files', direct FROM c UNION ALL SELECT 'directory count', 'n_files_recursive', total FROM c UNION ALL SELECT 'unclaimed', 'files', count(*) FROM k_files f WHERE f.path LIKE 'arch/arm/%' AND f.id NOT IN (SELECT ref_id FROM claims WHERE is_primary)
 UNION ALL SELECT 'file owner', name, rank FROM claims WHERE ref_id = 30 UNION ALL SELECT 'file kind', kind, count(*) FROM s GROUP BY kind
 UNION ALL SELECT 'symbol linkage', CASE WHEN is_static THEN 'static' ELSE 'global' END, 1 FROM k_symbols WHERE id = 31 UNION ALL SELECT 'ancestry', a.path, CAST(a.k AS BIGINT) FROM below a JOIN k_symbols s ON s.file_id = a.id WHERE s.id = 31""", "k_symbols " + OWN)
def info_cards(t: Tables) -> DataFrame:
    """A directory's, a file's and a symbol's card as rows."""
    def card(spec):  # noqa: E306
        return reports.describe_target(targets.resolve(spec, t.dirs, t.files, t.symbols).target, t.dirs, t.files, t.symbols, t.claims, t.sections, CATCH_ALL)

    file = t.files.filter("id = 30").first()["path"]
    sym = listing.symbol_entries(t.symbols.filter("id = 31"), t.files).first()
    directory, of_file, of_symbol = card("arch/arm"), card(file), card(f"{sym['path']}:{sym['name']}")
    rows = [("directory owner", o["name"], o["n_primary"]) for o in directory["owners"]] + [("directory count", k, directory["counts"][k]) for k in ("n_files", "n_files_recursive")] + [("unclaimed", "files", directory["unclaimed"])]
    rows += [("file owner", o["name"], o["rank"]) for o in of_file["owners"]] + [("file kind", k, n) for k, n in of_file["kinds"].items()]
    rows += [("symbol linkage", of_symbol["linkage"], 1)] + [("ancestry", p, k) for k, p in enumerate(of_symbol["ancestry"])]
    return t.spark.createDataFrame(rows, "part string, name string, n long")


# Calls and graphs.


def _top_flow(direction: str, own: str, other: str) -> str:
    return _FLOW % (own, other, direction, "NOT internal") + " ORDER BY edges DESC, subsystem NULLS FIRST LIMIT 3"


@query(_top_flow("outgoing", "source_file", "target_file"), _CALLS)
def call_flow_outgoing_top(t: Tables) -> DataFrame:
    return calls.flows(t.calls, t.symbols, t.claims, t.sections, SECTION, "outgoing", limit=3, catch_all=CATCH_ALL)


@query(_top_flow("incoming", "target_file", "source_file"), _CALLS)
def call_flow_incoming_top(t: Tables) -> DataFrame:
    """Each direction has its own limit."""
    return calls.flows(t.calls, t.symbols, t.claims, t.sections, SECTION, "incoming", limit=3, catch_all=CATCH_ALL)


@query(f"""{CLAIMS}, k AS (SELECT ref_id FROM claims WHERE is_primary AND subsystem_id = {SECTION}), c AS (SELECT c.resolution FROM k_calls c JOIN k_symbols s ON s.id = c.caller_id WHERE s.file_id IN (SELECT ref_id FROM k)) SELECT """ + ", ".join(f"count(*) FILTER (WHERE resolution = '{s}') AS {s}" for s in calls.STATUSES) + ", count(*) FILTER (WHERE resolution IN ('same_file', 'included_source', 'unique_global')) AS resolved, count(*) AS total FROM c", _CALLS)
def section_coverage(t: Tables) -> DataFrame:
    """How far one section's calls are resolved."""
    return calls.coverage(t.calls, t.symbols, t.claims, SECTION)


@query("x AS (SELECT 1) SELECT c.caller_id AS node, c.callee_id AS neighbour, c.callee, f.path, s.start_line, c.caller_id, c.resolution, c.direct_count, c.callee_id IS NOT NULL AND (c.indirect_count > 0 OR c.macro_count > 0) AS mixed FROM k_calls c JOIN k_symbols s ON s.id = c.caller_id JOIN k_files f ON f.id = s.file_id", "k_calls k_files")
def adjacency_outgoing(t: Tables) -> DataFrame:
    return graph.adjacency(t.calls, t.symbols, t.files)


@query("x AS (SELECT 1) SELECT c.callee_id AS node, c.caller_id AS neighbour, c.callee, f.path, s.start_line, c.caller_id, c.resolution, c.direct_count, FALSE AS mixed FROM k_calls c JOIN k_symbols s ON s.id = c.caller_id JOIN k_files f ON f.id = s.file_id WHERE c.callee_id IS NOT NULL", "k_calls k_files")
def adjacency_incoming(t: Tables) -> DataFrame:
    return graph.adjacency(t.calls, t.symbols, t.files, incoming=True)


# Levels in admission order: a neighbour belongs to the first row that names it.
_WALK = """e AS (SELECT caller_id AS a, callee_id AS b, callee FROM k_calls),
 r1 AS (SELECT a, b, row_number() OVER (ORDER BY callee, b NULLS FIRST) AS pos FROM e WHERE a = {start}), l1 AS (SELECT b AS node, arg_min(a, pos) AS parent, min(pos) AS first FROM r1 WHERE b IS NOT NULL AND b <> {start} GROUP BY 1), q1 AS (SELECT *, row_number() OVER (ORDER BY first) AS place FROM l1),
 r2 AS (SELECT e.a, e.b, row_number() OVER (ORDER BY q.place, e.callee, e.b NULLS FIRST) AS pos FROM q1 q JOIN e ON e.a = q.node), l2 AS (SELECT b AS node, arg_min(a, pos) AS parent, min(pos) AS first FROM r2 WHERE b IS NOT NULL AND b <> {start} AND b NOT IN (SELECT node FROM l1) GROUP BY 1), q2 AS (SELECT *, row_number() OVER (ORDER BY first) AS place FROM l2)"""


@query(_WALK.format(start=0) + """, cut AS (SELECT coalesce(min(first), 1000000000) AS pos FROM q2 WHERE place + (SELECT count(*) FROM q1) + 1 > 50),
 kept AS (SELECT 0 AS id, 0 AS level UNION ALL SELECT node, 1 FROM q1 UNION ALL SELECT node, 2 FROM q2 WHERE place + (SELECT count(*) FROM q1) + 1 <= 50),
 seen AS (SELECT a, b FROM r1 WHERE b IS NOT NULL UNION SELECT a, b FROM r2 WHERE b IS NOT NULL AND pos < (SELECT pos FROM cut)), reach(a, b) AS (SELECT a, b FROM seen UNION SELECT reach.a, seen.b FROM reach JOIN seen ON seen.a = reach.b)
 SELECT CAST(id AS BIGINT) AS id, CAST(level AS INT) AS level, EXISTS (SELECT 1 FROM reach WHERE a = b) AS cycle, CASE WHEN (SELECT pos FROM cut) < 1000000000 THEN 'node_limit' ELSE '' END AS truncated FROM kept""", "k_calls")
def bounded_exploration(t: Tables) -> DataFrame:
    found = graph.explore(graph.adjacency(t.calls, t.symbols, t.files), 0, depth=2, max_nodes=50)
    rows = [(n, lv, found.cycle, ",".join(found.truncated)) for n, lv in found.nodes.items()]
    return t.spark.createDataFrame(rows, "id long, level int, cycle boolean, truncated string")


@query(_WALK.format(start=0) + """, r3 AS (SELECT e.a, e.b, row_number() OVER (ORDER BY q.place, e.callee, e.b NULLS FIRST) AS pos FROM q2 q JOIN e ON e.a = q.node), l3 AS (SELECT b AS node, arg_min(a, pos) AS parent FROM r3 WHERE b IS NOT NULL AND b <> 0 AND b NOT IN (SELECT node FROM l1 UNION ALL SELECT node FROM l2) GROUP BY 1),
 found AS (SELECT node, parent, 1 AS level FROM l1 UNION ALL SELECT node, parent, 2 FROM l2 UNION ALL SELECT node, parent, 3 FROM l3), way(node, parent, level) AS (SELECT node, parent, level FROM found WHERE node = 5 UNION ALL SELECT f.node, f.parent, f.level FROM way w JOIN found f ON f.node = w.parent)
 SELECT CAST(level AS INT) AS hop, node AS id FROM way UNION ALL SELECT 0, 0""", "k_calls")
def shortest_path(t: Tables) -> DataFrame:
    """The first of the shortest paths over up to three calls, as far as the SQL looks."""
    return graph.shortest_path(t.calls.select(F.col("caller_id").alias("src"), F.col("callee_id").alias("dst"), "callee"), 0, 5, 3)


@query("s AS (SELECT k.caller_id, a.name AS caller, k.callee, c.callee_id, k.kind, c.resolution, f.path, k.line, k.byte_offset FROM k_sites k JOIN k_calls c ON c.caller_id = k.caller_id AND c.callee = k.callee JOIN k_symbols a ON a.id = k.caller_id JOIN k_files f ON f.id = a.file_id WHERE k.caller_id = 17 ORDER BY path, line, byte_offset, caller_id, callee, kind LIMIT 10), n AS (SELECT count(*) > 10 AS truncated FROM k_sites WHERE caller_id = 17) SELECT s.*, n.truncated FROM s, n", "k_calls k_files")
def call_sites_limited(t: Tables) -> DataFrame:
    """One symbol's first ten outgoing sites, and whether there are more."""
    rows, cut = calls.call_sites(t.sites, t.calls, t.symbols, t.files, symbol_id=17, limit=10)
    return rows.withColumn("truncated", F.lit(cut))


@query("x AS (SELECT 1) SELECT domain, file_id FROM (SELECT DISTINCT d.domain, split_part(substr(d.domain, 9), ':', 1) AS root FROM k_domains d WHERE d.domain LIKE 'program:%') p JOIN k_domains h ON h.path LIKE replace(p.root, '_', '\\_') || '/%' ESCAPE '\\' WHERE h.ext IN ('.h', '.h_shipped')".replace("SELECT domain, file_id", "SELECT p.domain, h.file_id"), "k_domains")
def program_headers(t: Tables) -> DataFrame:
    return resolution.program_headers(t.domains)


@query("""d AS (SELECT DISTINCT domain, path FROM k_domains), p AS (SELECT domain, domain AS candidate, FALSE AS shared_only FROM d UNION SELECT domain, 'kernel', FALSE FROM d WHERE domain LIKE 'arch:%' UNION SELECT domain, 'kernel', TRUE FROM d WHERE domain LIKE 'image:%' UNION SELECT domain, 'arch:' || split_part(path, '/', 2), TRUE FROM d WHERE domain LIKE 'image:%' AND path LIKE 'arch/%/%')
 SELECT domain, candidate, min(shared_only) AS shared_only FROM p GROUP BY 1, 2""", "k_domains")
def eligible_domains(t: Tables) -> DataFrame:
    return resolution.eligible_domains(t.domains)


@query(_RESOLVE.rsplit("SELECT cf AS", 1)[0] + """, ex AS (SELECT cf, name, CASE WHEN count(DISTINCT r) = 1 AND (min(r) NOT IN ('same_file', 'included_source', 'unique_global') OR count(DISTINCT id) = 1) THEN min(r) ELSE 'ambiguous' END AS resolution, CASE WHEN count(DISTINCT r) = 1 AND min(r) IN ('same_file', 'included_source', 'unique_global') AND count(DISTINCT id) = 1 THEN min(id) END AS callee_id FROM od GROUP BY 1, 2)
 SELECT c.resolution, count(*) AS n FROM k_calls c JOIN k_symbols s ON s.id = c.caller_id LEFT JOIN ex ON ex.cf = s.file_id AND ex.name = c.callee WHERE c.direct_count > 0 AND (c.resolution IS DISTINCT FROM ex.resolution OR c.callee_id IS DISTINCT FROM ex.callee_id) GROUP BY 1""", "k_calls k_files k_includes")
def rederived_outcomes(t: Tables) -> DataFrame:
    """Recorded identities of the adapter that differ from derived ones, by what is recorded."""
    expected = resolution.resolve(t.files, t.symbols, t.includes, calls.grouped_occurrences(t.sites))
    return audit.outcomes(t.calls, t.symbols, expected).groupBy("resolution").agg(F.count("*").alias("n"))


# Structures.

_RELATED = """t AS (SELECT s.id AS target_id, s.file_id AS tf, f.ext, s.kind AS tk, s.name AS tn, s.start_line AS ts FROM k_symbols s JOIN k_files f ON f.id = s.file_id WHERE s.kind IN ('struct', 'union', 'enum')),
 k AS (SELECT *, tn AS key, tk AS kk FROM t UNION ALL SELECT t.*, a.name, 'typedef' FROM t JOIN k_aliases a ON a.symbol_id = t.target_id),
 m AS (SELECT r.*, k.target_id, CASE WHEN EXISTS (SELECT 1 FROM k_symbols g WHERE g.kind IN ('function', 'syscall') AND g.file_id = k.tf AND g.file_id = r.file_id AND k.ts BETWEEN g.start_line AND g.end_line AND r.line BETWEEN g.start_line AND g.end_line) THEN 0 WHEN r.file_id = k.tf THEN 1 WHEN k.ext IN ('.h', '.h_shipped') THEN 2 END AS scope FROM k_references r JOIN k ON k.key = r.name AND k.kk = r.kind),
 d AS (SELECT file_id, line, owner_id, kind, name, role, target_id, min(scope) AS scope FROM m WHERE scope IS NOT NULL GROUP BY ALL), b AS (SELECT *, min(scope) OVER (PARTITION BY file_id, line, owner_id, kind, name, role) AS best FROM d),
 rel AS (SELECT *, count(*) OVER (PARTITION BY file_id, line, owner_id, kind, name, role) AS candidates, row_number() OVER (PARTITION BY file_id, line, owner_id, kind, name, role ORDER BY target_id) AS pos FROM b WHERE scope = best)"""


@query(f"{_RELATED} SELECT file_id, line, owner_id, kind, name, role, target_id, CAST(scope AS INT) AS scope, candidates, candidates > 1 AS ambiguous FROM rel WHERE pos <= 100", "k_references k_aliases k_files")
def type_relationships(t: Tables) -> DataFrame:
    return structures.relationships(t.references, t.symbols, t.aliases, t.files)


@query(f"{_RELATED} SELECT target_id, role, count(*) AS n, count(*) FILTER (WHERE candidates > 1) AS ambiguous FROM rel WHERE pos <= 100 GROUP BY 1, 2", "k_references k_aliases k_files")
def structure_usage(t: Tables) -> DataFrame:
    """How often each type is meant, by role: the body of the structure report."""
    return structures.usage(t.references, t.symbols, t.aliases, t.files)


@query(f"""{_RELATED}, me AS (SELECT s.id, s.name, f.path FROM k_symbols s JOIN k_files f ON f.id = s.file_id WHERE s.kind = 'struct' ORDER BY s.id LIMIT 1)
 SELECT 'used_by' AS part, role AS name, count(*) AS n FROM rel, me WHERE pos <= 100 AND target_id = me.id GROUP BY role UNION ALL SELECT 'alias', a.name, 1 FROM k_aliases a, me WHERE a.symbol_id = me.id UNION ALL SELECT 'members', 'all', count(*) FROM k_members m, me WHERE m.symbol_id = me.id HAVING count(*) > 0
 UNION ALL SELECT 'members', 'top', count(*) FROM k_members m, me WHERE m.symbol_id = me.id AND (m.parent_id IS NULL OR m.parent_id NOT IN (SELECT x.id FROM k_members x, me WHERE x.symbol_id = me.id))""", "k_references k_aliases k_members k_files")
def structure_report(t: Tables) -> DataFrame:
    """The first structure's report as rows."""
    me = listing.symbol_entries(t.symbols.filter("kind = 'struct'"), t.files).orderBy("ref_id").first()
    target = t.symbols.filter(F.col("id") == me["ref_id"]).withColumn("path", F.lit(me["path"])).first()
    out = reports.structure_report(target, t.members, t.aliases, t.references, t.symbols, t.files)
    rows = [("used_by", r["role"], r["n"]) for r in out["used_by"]] + [("alias", a, 1) for a in out["aliases"]] + [("members", "top", len(out["members"]))]
    if out["coverage"]:
        rows.append(("members", "all", out["coverage"]["total"]))
    return t.spark.createDataFrame(rows, "part string, name string, n long")


@query("s AS (SELECT * FROM k_symbols WHERE kind IN ('struct', 'union')) SELECT 't_7' AS asked, id, name FROM s WHERE name = 't_7' OR id IN (SELECT symbol_id FROM k_aliases WHERE name = 't_7') UNION ALL SELECT 'name', s.id, s.name FROM s WHERE s.name = (SELECT name FROM s ORDER BY id LIMIT 1)", "k_aliases k_symbols")
def structure_resolution(t: Tables) -> DataFrame:
    """All definitions that an alias and a tag mean."""
    name = t.symbols.filter("kind = 'struct'").orderBy("id").first()["name"]
    by = lambda asked, n: structures.resolve_structure(t.symbols, t.aliases, n).select(F.lit(asked).alias("asked"), "id", "name")
    return by("t_7", "t_7").union(by("name", name))


# Texts and documents.

_HITS = rf"""{_LINES}, p AS (SELECT *, trim(text) AS title, lead(trim(text)) OVER (PARTITION BY path ORDER BY line) AS below FROM l),
 o AS (SELECT *, CASE WHEN title <> '' AND length(below) >= greatest(3, length(title)) AND contains('=-~^"''`:+#*', below[1]) AND below = repeat(below[1], CAST(length(below) AS BIGINT)) THEN title ELSE nullif(trim(regexp_extract(text, '^ {{0,3}}#{{1,6}}[ \t]+(.*?)(?:[ \t]+#*)?$', 1)), '') END AS own FROM p),
 h AS (SELECT path, line, text, last_value(own IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM o),
 s AS (SELECT *, strpos(lower(text), '%s') - 1 AS start FROM h WHERE contains(lower(text), '%s')), c AS (SELECT *, greatest(0, start - 70) AS a, least(length(text), greatest(start + %d, greatest(0, start - 70) + 240)) AS z FROM s),
 w AS (SELECT *, trim(regexp_replace(substr(text, a + 1, z - a), '\s+', ' ', 'g')) AS cut FROM c)
 SELECT path, CAST(line AS INT) AS line, 'documentation' AS source_kind, heading, CASE WHEN a > 0 THEN '…' ELSE '' END || substr(cut, 1, 240) || CASE WHEN z < length(text) OR length(cut) > 240 THEN '…' ELSE '' END AS snippet FROM w"""


@query(_HITS % (("license",) * 2 + (7,)) + " ORDER BY path, line LIMIT 5000", "k_documents")
def text_hits(t: Tables) -> DataFrame:
    """Hits with heading, snippet and kind of source."""
    return text.search(t.documents, "License")


@query(f"{_LINES}, m AS (SELECT * FROM l WHERE contains(lower(text), 'license') AND path LIKE 'Documentation/%') SELECT path, CAST(line AS INT) AS line FROM m WHERE path LIKE 'Documentation/src0/%'", "k_documents")
def text_in_scope(t: Tables) -> DataFrame:
    return text.search(t.documents, "license", scope=text.in_documentation("src0/"), limit=None).select("path", "line")


@query(f"""{ENTRY_SYMBOLS}, k AS (SELECT symbol_id, line, section, text FROM (SELECT symbol_id, line, unnest(['summary', 'returns']) AS section, unnest([summary, returns]) AS text FROM k_contracts) WHERE coalesce(text, '') <> '')
 SELECT e.path, k.line, k.section AS heading FROM k JOIN entries e ON e.ref_id = k.symbol_id WHERE contains(lower(k.text), 'the')""", "k_symbols k_files k_contracts")
def contract_hits(t: Tables) -> DataFrame:
    """Hits in function contracts, by section."""
    contracts = t.contracts.withColumn("parameters", F.lit(None).cast("array<struct<name:string,text:string>>"))
    found = text.search(t.documents.filter("false"), "the", contracts=text.contract_texts(contracts, t.symbols, t.files), limit=None)
    return found.select("path", "line", "heading")


@query(f"""{ENTRY_SYMBOLS}, d AS (SELECT name, min(CASE WHEN kind IN ('function', 'syscall') THEN 0 WHEN kind IN ('struct', 'union', 'enum') THEN 1 WHEN kind = 'typedef' THEN 2 ELSE 3 END) AS k, max(is_exported::INT) AS e FROM k_symbols WHERE file_id = 30 AND kind IN ('function', 'syscall', 'struct', 'union', 'enum', 'typedef', 'variable') GROUP BY 1)
 SELECT name FROM d ORDER BY k, e DESC, length(name) DESC, name LIMIT 192""", "k_symbols k_files")
def declared_names(t: Tables) -> DataFrame:
    return docs.declarations(t.symbols, 30)


_TERMS = "list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(%s, '\\.[^./]+$', '')), '[a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN (" + ", ".join(f"'{w}'" for w in strings.STOP_WORDS) + ")))"


@query(f"""n AS (SELECT DISTINCT name FROM k_symbols WHERE file_id = 30 AND kind IN ('function', 'syscall', 'struct', 'union', 'enum', 'typedef', 'variable')), meaning AS (SELECT DISTINCT unnest({_TERMS % "'net/ipv4/tcp.c'"}) AS a UNION SELECT DISTINCT unnest({_TERMS % "name"}) FROM n), identity AS (SELECT 'tcp' AS a),
 d AS (SELECT path, name, {_TERMS % "regexp_replace(path, '^Documentation/', '')"} AS own FROM k_documents),
 t AS (SELECT path, unnest(own) AS b FROM d), pair AS (SELECT t.path, m.a, t.b, (SELECT coalesce(max(k), 0) FROM range(1, 13) r(k) WHERE length(m.a) >= k AND length(t.b) >= k AND substr(m.a, 1, k) = substr(t.b, 1, k)) AS common FROM t, (SELECT DISTINCT a FROM meaning UNION SELECT a FROM identity) m),
 alike AS (SELECT path, a, max(CASE WHEN a = b THEN 30 + least(length(a), 12) WHEN common >= 4 THEN 5 + common ELSE 0 END) AS s FROM pair GROUP BY 1, 2),
 ms AS (SELECT path, sum(s) AS s FROM alike WHERE a IN (SELECT a FROM meaning) GROUP BY 1), ps AS (SELECT path, sum(s) AS s FROM alike WHERE a IN (SELECT a FROM identity) GROUP BY 1),
 own AS (SELECT d.path, min(CASE c.subsystem_id WHEN 7 THEN 0 WHEN 3 THEN 1 END) AS owner FROM k_raw_claims c JOIN k_documents d ON d.file_id = c.ref_id WHERE c.subsystem_id IN (7, 3) GROUP BY 1),
 r AS (SELECT d.path, d.name, coalesce(ps.s, 0) AS path_score, coalesce(ms.s, 0) AS meaning_score, own.owner, lower(d.path) SIMILAR TO '.*\\.(rst|txt|md)' AND d.path NOT LIKE 'Documentation/devicetree/bindings/%' AS guide FROM d LEFT JOIN ms USING (path) LEFT JOIN ps USING (path) LEFT JOIN own USING (path)),
 q AS (SELECT *, CASE WHEN owner IS NOT NULL AND meaning_score > 0 THEN 2 WHEN path_score > 0 THEN 3 WHEN owner IS NOT NULL THEN 4 END AS tier FROM r)
 SELECT path, name, CAST(tier AS INT) AS tier, CASE WHEN guide THEN 0 ELSE 1 END AS purpose, CAST(path_score AS INT) AS path_score, CAST(meaning_score AS INT) AS meaning_score,
  list_filter([CASE WHEN owner IS NOT NULL THEN 'claimed by an owner of the target' END, CASE WHEN path_score > 0 THEN 'its name shares terms with the target''s' END, CASE WHEN meaning_score > 0 THEN 'its path shares terms with the target''s subject' END, CASE WHEN guide THEN 'prose' END], lambda x: x IS NOT NULL) AS reasons
 FROM q WHERE tier IS NOT NULL""", "k_documents k_symbols k_raw_claims")
def doc_rank(t: Tables) -> DataFrame:
    study = docs.Study("src7/net/ipv4/tcp.c", "file", declarations=[r["name"] for r in docs.declarations(t.symbols, 30).collect()], owners=[7, 3])
    table = t.documents.select("path", "name", "size", F.lit(None).cast("long").alias("lines"), "file_id")
    owner_of = t.raw_claims.join(t.documents.select(F.col("file_id").alias("ref_id"), "path"), "ref_id").select("path", "subsystem_id")
    return docs.rank(study, table, owner_of)


@query(f"""{ENTRY_SYMBOLS}, f AS (SELECT e.event_id, e.event_type || '_' || (e.event_id % 3) AS frame FROM events e CROSS JOIN (SELECT 3 AS line UNION ALL SELECT 4) x), n AS (SELECT s.*, CASE s.ref_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' WHEN 3 THEN 'signup' ELSE 'none' END || '_' || (s.ref_id % 4) AS own FROM entries s),
 r AS (SELECT own, path, row_number() OVER (PARTITION BY own ORDER BY {_RANK}) AS rank FROM n) SELECT {_AREA % "r.path"} AS area, count(*) AS n FROM f LEFT JOIN r ON r.own = f.frame AND r.rank = 1 GROUP BY 1""", "k_symbols k_files")
def trace_areas(t: Tables) -> DataFrame:
    """How many frames lie in each area."""
    from codestrata.plans.catalogue import QUERIES

    return text.area_histogram(QUERIES["trace_annotate"](t.spark, t._dir))


# Audits with planted faults: every check must find its own.


@query(f"""{CLAIMS}, p AS (SELECT CASE WHEN ref_id % 97 = 1 THEN rank + 1 ELSE rank END AS rank, CASE WHEN ref_id % 89 = 2 THEN NOT is_primary ELSE is_primary END AS is_primary, ref_id, rank AS r0, is_primary AS p0 FROM claims), per AS (SELECT ref_id, min(rank) AS lo, max(rank) AS hi, count(*) AS n, count(DISTINCT rank) AS d FROM p GROUP BY 1), {BELOW}, dirs AS (SELECT DISTINCT path FROM below)
 SELECT 'claim_rank' AS "check", (SELECT count(*) FROM p WHERE rank <> r0) AS n UNION ALL SELECT 'claim_primary', (SELECT count(*) FROM p WHERE is_primary <> p0) UNION ALL SELECT 'claim_gaps', (SELECT count(*) FROM per WHERE lo <> 0 OR hi <> n - 1 OR d <> n)
 UNION ALL SELECT 'calls', (SELECT count(*) FROM k_calls WHERE caller_id % 53 = 3) UNION ALL SELECT 'symbols', (SELECT count(*) FROM k_symbols WHERE id % 61 = 4 OR id % 59 = 5 OR id % 67 = 6) UNION ALL SELECT 'files', (SELECT count(*) FROM k_files WHERE id % 71 = 7) UNION ALL SELECT 'call_sites', (SELECT count(*) FROM k_sites WHERE caller_id % 41 = 8 OR byte_offset % 43 = 9)
 UNION ALL SELECT 'type_members', (SELECT count(*) FROM k_members WHERE id % 73 = 1) UNION ALL SELECT 'path_subsys', (SELECT count(*) FROM claims WHERE ref_id % 79 = 3)
 UNION ALL SELECT 'file_name', (SELECT count(*) FROM k_files WHERE id % 83 = 5) UNION ALL SELECT 'file_ext', (SELECT count(*) FROM k_files WHERE id % 101 = 6) UNION ALL SELECT 'file_directory', (SELECT count(*) FROM k_files WHERE path LIKE 'fs/brand\\_11/%' ESCAPE '\\') UNION ALL SELECT 'directory_parent', 0
 UNION ALL SELECT 'directory_depth', (SELECT count(*) FROM dirs WHERE path LIKE 'arch/%' AND path <> 'fs/brand_11')
 UNION ALL SELECT 'symbol_file', (SELECT count(*) FROM k_symbols WHERE file_id IN (SELECT id FROM k_files WHERE id % 103 = 9)) UNION ALL SELECT 'member_order', (SELECT count(DISTINCT symbol_id) FROM k_members WHERE id % 73 = 1 OR id % 3 > 0 AND id - 1 NOT IN (SELECT x.id FROM k_members x WHERE x.symbol_id = k_members.symbol_id))
 UNION ALL SELECT 'twice', (SELECT count(*) FROM k_files WHERE id % 107 = 2) UNION ALL SELECT 'totals', (SELECT count(*) FROM dirs WHERE path LIKE 'drivers/%')""", "k_calls k_members " + OWN)
def planted_faults(t: Tables) -> DataFrame:
    """Each check over evidence with a fault planted by a residue of its ids."""
    pick = lambda c, m, r: F.col(c) % m == r
    claims = t.claims.withColumn("rank", F.when(pick("ref_id", 97, 1), F.col("rank") + 1).otherwise(F.col("rank"))).withColumn("is_primary", F.when(pick("ref_id", 89, 2), ~F.col("is_primary")).otherwise(F.col("is_primary")))
    found = audit.ownership(t.files, claims, t.sections, paths.directory_owners(t.files, t.claims, t.sections, CATCH_ALL), CATCH_ALL)
    checks = {k: found[k] for k in ("claim_rank", "claim_primary", "claim_gaps")}
    symbols = t.symbols.withColumn("kind", F.when(pick("id", 61, 4), "thing").otherwise(F.col("kind"))).withColumn("name", F.when(pick("id", 59, 5), "").otherwise(F.col("name"))).withColumn("end_line", F.when(pick("id", 67, 6), F.col("start_line") - 1).otherwise(F.col("end_line")))
    checks |= audit.row_domains({
        "calls": t.calls.withColumn("resolution", F.when(pick("caller_id", 53, 3), "guessed").otherwise(F.col("resolution"))),
        "symbols": symbols,
        "files": t.files.withColumn("size", F.when(pick("id", 71, 7), -1).otherwise(F.col("size"))),
        "call_sites": t.sites.withColumn("kind", F.when(pick("caller_id", 41, 8), "other").otherwise(F.col("kind"))).withColumn("byte_offset", F.when(pick("byte_offset", 43, 9), -1).otherwise(F.col("byte_offset"))),
        "type_members": t.members.withColumn("ordinal", F.when(pick("id", 73, 1), -1).otherwise(F.col("ordinal"))),
        "path_subsys": t.claims.withColumn("score", F.when(~pick("ref_id", 79, 3), F.col("score"))),
    })
    dirs = t.dirs.filter("path != 'fs/brand_11'")
    deep = dirs.withColumn("depth", F.when(F.col("path").startswith("arch/"), F.col("depth") + 1).otherwise(F.col("depth")))
    files = t.files.withColumn("name", F.when(pick("id", 83, 5), F.concat(F.lit("x"), "name")).otherwise(F.col("name"))).withColumn("ext", F.when(pick("id", 101, 6), ".x").otherwise(F.col("ext")))
    checks |= audit.paths(files, deep)
    checks["symbol_file"] = audit.dangling(t.symbols, "file_id", t.files.filter(~pick("id", 103, 9)))
    checks["member_order"] = audit.preorder(t.members.withColumn("ordinal", F.when(pick("id", 73, 1), -1).otherwise(F.col("ordinal"))))
    checks["twice"] = audit.duplicates(t.files.union(t.files.filter(pick("id", 107, 2))), ["path"])
    wrong = paths.directory_counts(t.files).withColumn("n_files_recursive", F.when(F.col("path").startswith("drivers/"), F.col("n_files_recursive") + 1).otherwise(F.col("n_files_recursive")))
    checks["totals"] = audit.directory_totals(t.files, wrong)
    return audit.violations(checks)

