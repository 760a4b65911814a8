"""Aggregates: members in preorder, coverage, aliases and relationships between declared types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from codestrata.functions.storage import materialize
from codestrata.functions.text import ratio

CANDIDATES = 100


def detail(members: DataFrame, symbol_id: int | None = None) -> DataFrame:
    """Members in preorder with depth and dotted path, unnamed members left out of paths; a flat table, as members nest
    without bound. A round per level of nesting; members that hang on a cycle have neither depth nor path."""
    rows = members if symbol_id is None else members.filter(F.col("symbol_id") == symbol_id)
    nodes = materialize(rows.select("id", "symbol_id", "parent_id", "name"), "members")
    above = F.col("parent_id").eqNullSafe(F.col("p")) & (F.col("symbol_id") == F.col("ps"))
    tops = nodes.join(nodes.select(F.col("id").alias("p"), F.col("symbol_id").alias("ps")), above, "left_anti")
    level = placed = materialize(tops.select("id", "symbol_id", F.lit(0).alias("depth"), F.coalesce("name", F.lit("")).alias("dotted")), "level")
    while True:
        p = level.select(F.col("id").alias("p"), F.col("symbol_id").alias("ps"), F.col("depth").alias("d"), F.col("dotted").alias("at"))
        below = nodes.join(p, above).select("id", "symbol_id", (F.col("d") + 1).alias("depth"), F.concat_ws(".", F.nullif("at", F.lit("")), "name").alias("dotted"))
        level = materialize(below, "level")
        if level.isEmpty():
            break
        placed = placed.union(level)
    flexible = F.coalesce(F.try_element_at("array_dimensions", F.lit(-1)) == "", F.lit(False)) if "array_dimensions" in members.columns else F.lit(False)
    keep = [c for c in rows.columns if c not in ("depth", "dotted")]
    return rows.select(*keep).join(placed.drop("symbol_id"), "id", "left").withColumn("flexible", flexible).orderBy("symbol_id", "ordinal")


def nested(rows: list[Row]) -> list[dict]:
    """The member tree of one aggregate, from its rows in preorder."""
    top: list[dict] = []
    by_id: dict[int, dict] = {}
    for r in rows:
        node = r.asDict() | {"members": []}
        by_id[r["id"]] = node
        (by_id[r["parent_id"]]["members"] if r["parent_id"] in by_id else top).append(node)
    return top


def coverage(members: DataFrame) -> DataFrame:
    """(symbol_id, direct, total, documentable, described, documented, semantic, ratio) of each aggregate.

    Documentable are named members; described have a text; documented have one from the source;
    semantic texts follow from a macro. The ratio is documented over documentable.
    """
    named = F.col("name").isNotNull()
    source = F.col("description_source")
    counts = {"documentable": named, "described": named & F.col("description").isNotNull(), "documented": named & source.isin("kernel-doc", "inline-kernel-doc", "source-comment"), "semantic": source == "macro-semantics"}
    out = members.groupBy("symbol_id").agg(F.count_if(F.col("parent_id").isNull()).alias("direct"), F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    return out.withColumn("ratio", ratio(F.col("documented"), F.col("documentable")))


def resolve_structure(symbols: DataFrame, aliases: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    """All struct and union definitions of a tag or typedef alias; several stay several."""
    rows = symbols.filter(F.col("kind").isin("struct", "union") if kind is None else F.col("kind") == kind)
    also = aliases.filter(F.col("name") == name).select(F.col("symbol_id").alias("id"))
    return rows.filter(F.col("name") == name).unionByName(rows.join(also, "id", "left_semi").select(rows.columns)).dropDuplicates(["id"])


_REFERENCE = ["file_id", "line", "owner_id", "kind", "name", "role"]


def _names(symbols: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """(key_kind, key, target_id, …): what each struct, union and enum is called: its tag, and typedefs."""
    types = symbols.filter(F.col("kind").isin("struct", "union", "enum")).join(files.select(F.col("id").alias("file_id"), "ext"), "file_id").select(F.col("id").alias("target_id"), F.col("file_id").alias("target_file"), "ext", F.col("kind").alias("target_kind"), F.col("name").alias("target_name"), "start_line")
    tagged = types.select("*", F.col("target_name").alias("key"), F.col("target_kind").alias("key_kind"))
    aliased = types.join(aliases.select(F.col("symbol_id").alias("target_id"), F.col("name").alias("key")), "target_id").select(*types.columns, "key", F.lit("typedef").alias("key_kind"))
    return tagged.unionByName(aliased)


def _counted(rows: DataFrame, keys: list[str], cap: int | None) -> DataFrame:
    """rows with the exact number of targets of their keys; with a cap, only the first ``cap`` of them."""
    of = Window.partitionBy(*keys)
    rows = rows.withColumn("candidates", F.count("*").over(of))
    return rows if cap is None else rows.withColumn("at", F.row_number().over(of.orderBy("target_id"))).filter(F.col("at") <= cap).drop("at")


def _candidates(references: DataFrame, symbols: DataFrame, aliases: DataFrame, files: DataFrame, cap: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References with a definition in their own file, a row per candidate; all others, once each; and (kind, name, target_id,
    candidates) of the headers. Which of the two a reference is, its file, kind and name tell; what headers offer is the same for
    all references of a kind and name and is listed once. References are dealt once, by what tells the two apart."""
    named = _names(symbols, aliases, files)
    dealt = references.select(*_REFERENCE).repartition("file_id", "kind", "name")
    here = named.select(F.col("target_file").alias("file_id"), F.col("key_kind").alias("kind"), F.col("key").alias("name"), "target_id", "start_line")
    keys = here.select("file_id", "kind", "name").distinct().hint("shuffle_hash")  # no key twice, so no task meets more than its share
    elsewhere = dealt.join(keys, ["file_id", "kind", "name"], "left_anti").distinct()
    functions = symbols.filter(F.col("kind").isin("function", "syscall")).select(F.col("file_id").alias("span_file"), F.col("start_line").alias("span_start"), F.col("end_line").alias("span_end"))
    inner = dealt.join(keys, ["file_id", "kind", "name"], "left_semi").distinct().join(here, ["file_id", "kind", "name"]).join(functions, (F.col("file_id") == F.col("span_file")) & F.col("start_line").between(F.col("span_start"), F.col("span_end")) & F.col("line").between(F.col("span_start"), F.col("span_end")), "left")
    rows = inner.withColumn("scope", F.when(F.col("span_start").isNotNull(), 0).otherwise(1)).groupBy(*_REFERENCE, "target_id").agg(F.min("scope").alias("scope"))
    rows = rows.withColumn("best", F.min("scope").over(Window.partitionBy(*_REFERENCE))).filter("scope = best")
    heads = named.filter(F.col("ext").isin(".h", ".h_shipped")).select(F.col("key_kind").alias("kind"), F.col("key").alias("name"), "target_id").distinct()
    return _counted(rows, _REFERENCE, cap).select(*_REFERENCE, "target_id", "scope", "candidates"), elsewhere, _counted(heads, ["kind", "name"], cap)


def relationships(references: DataFrame, symbols: DataFrame, aliases: DataFrame, files: DataFrame, cap: int = CANDIDATES) -> DataFrame:
    """References (file_id, line, owner_id, kind, name, role) to the definitions they can mean.

    A definition inside the same function comes before one of the same file, that before headers;
    the best scope's candidates all stay, with their exact number, listed up to ``cap``.
    """
    near, elsewhere, heads = _candidates(references, symbols, aliases, files, cap)
    heads = heads.groupBy("kind", "name").agg(F.max("candidates").alias("candidates"), F.collect_list("target_id").alias("targets"))
    far = elsewhere.join(heads, ["kind", "name"]).select(*_REFERENCE, F.explode("targets").alias("target_id"), F.lit(2).alias("scope"), "candidates")
    return near.union(far).withColumn("ambiguous", F.col("candidates") > 1)


def usage(references: DataFrame, symbols: DataFrame, aliases: DataFrame, files: DataFrame, cap: int | None = None) -> DataFrame:
    """(target_id, role, n, ambiguous): references counted for every definition they can mean, those in headers by name and not
    one by one. With a cap, the rows of relationships() under it."""
    near, elsewhere, heads = _candidates(references, symbols, aliases, files, cap)
    ambiguous = F.when(F.col("candidates") > 1, F.col("n")).otherwise(F.lit(0).cast("long")).alias("ambiguous")
    near = near.groupBy("target_id", "role").agg(F.count("*").alias("n"), F.count_if(F.col("candidates") > 1).alias("ambiguous"))
    far = elsewhere.groupBy("kind", "name", "role").agg(F.count("*").alias("n")).join(heads, ["kind", "name"]).select("target_id", "role", "n", ambiguous)
    return near.unionByName(far).groupBy("target_id", "role").agg(F.sum("n").alias("n"), F.sum("ambiguous").alias("ambiguous"))


def used_by(target_id: int, references: DataFrame, symbols: DataFrame, aliases: DataFrame, files: DataFrame, cap: int | None = None) -> DataFrame:
    """(role, n, ambiguous) of one type, however many share its names; only references by a name of its own are looked at."""
    called = F.lit(False)
    for r in _names(symbols, aliases, files).filter(F.col("target_id") == target_id).select("key_kind", "key").distinct().collect():  # one type's names
        called = called | ((F.col("kind") == r["key_kind"]) & (F.col("name") == r["key"]))
    return usage(references.filter(called), symbols, aliases, files, cap).filter(F.col("target_id") == target_id).drop("target_id")
