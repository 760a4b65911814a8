"""Call edges: flat listings, occurrences, flows between owners and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.functions.owners import CATCH_ALL_NAME

RESOLVED = ("same_file", "included_source", "unique_global")
STATUSES = ("same_file", "included_source", "unique_global", "ambiguous", "macro", "indirect", "unresolved")


def grouped_occurrences(sites: DataFrame) -> DataFrame:
    """Call sites (caller_id, callee, kind) to edges with counts and an initial status."""
    counts = sites.groupBy("caller_id", "callee").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("direct", "indirect", "macro")])
    status = F.when(F.col("direct_count") > 0, "unresolved").when(F.col("macro_count") > 0, "macro").otherwise("indirect")
    return counts.withColumn("resolution", status)


def callees(calls: DataFrame, symbols: DataFrame, files: DataFrame, caller_id: int | None = None) -> DataFrame:
    """Who is called; an unresolved callee has kind ``?`` and path ``-``."""
    rows = calls if caller_id is None else calls.filter(F.col("caller_id") == caller_id)
    target = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("id").alias("callee_id"), "kind", "path", F.col("start_line").alias("line"))
    return rows.join(target, "callee_id", "left").select("caller_id", "callee", F.coalesce("kind", F.lit("?")).alias("kind"), F.coalesce("path", F.lit("-")).alias("path"), "line", "resolution", "direct_count", "indirect_count", "macro_count")


def callers(calls: DataFrame, symbols: DataFrame, files: DataFrame, callee_id: int | None = None) -> DataFrame:
    """Who calls: counts summed by caller and resolution."""
    rows = calls.filter("callee_id is not null") if callee_id is None else calls.filter(F.col("callee_id") == callee_id)
    sums = rows.groupBy("callee_id", "caller_id", "resolution").agg(*[F.sum(f"{k}_count").alias(f"{k}_count") for k in ("direct", "indirect", "macro")])
    caller = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("id").alias("caller_id"), "name", "kind", "path", F.col("start_line").alias("line"))
    return sums.join(caller, "caller_id")


def call_sites(sites: DataFrame, calls: DataFrame, symbols: DataFrame, files: DataFrame, symbol_id: int | None = None, incoming: bool = False, limit: int = 0) -> tuple[DataFrame, bool]:
    """(occurrences, whether the limit cut them). Incoming ones are direct sites only."""
    caller = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("id").alias("caller_id"), F.col("name").alias("caller"), "path")
    rows = sites.join(calls.select("caller_id", "callee", "callee_id", "resolution"), ["caller_id", "callee"]).join(caller, "caller_id")
    if incoming:
        rows = rows.filter("kind = 'direct' and callee_id is not null")
    if symbol_id is not None:
        rows = rows.filter(F.col("callee_id" if incoming else "caller_id") == symbol_id)
    rows = rows.select("caller_id", "caller", "callee", "callee_id", "kind", "resolution", "path", "line", "byte_offset").orderBy("path", "line", "byte_offset", "caller_id", "callee", "kind")
    if not limit:
        return rows, False
    return rows.limit(limit), len(rows.limit(limit + 1).take(limit + 1)) > limit


def flows(calls: DataFrame, symbols: DataFrame, claims: DataFrame, sections: DataFrame, subsystem_id: int, direction: str, include_internal: bool = False, min_edges: int = 1, limit: int = 0, catch_all: str = CATCH_ALL_NAME) -> DataFrame:
    """Resolved calls between one section's files and others', by the other side's primary owner.

    A call counts only between files without a common primary owner, or towards the section
    itself. Files without owner and catch-all owners are one unclassified group.
    """
    if direction not in ("outgoing", "incoming"):
        raise ValueError(f"unknown call-flow direction: {direction}")
    end = symbols.select("id", "file_id")
    edges = calls.filter(F.col("callee_id").isNotNull() & F.col("resolution").isin(*RESOLVED)).select("caller_id", "callee_id")
    edges = edges.join(end.select(F.col("id").alias("caller_id"), F.col("file_id").alias("source_file")), "caller_id").join(end.select(F.col("id").alias("callee_id"), F.col("file_id").alias("target_file")), "callee_id")
    primary = claims.filter("is_primary").select("ref_id", F.col("subsystem_id").alias("owner"))
    own_side, other_side = ("source_file", "target_file") if direction == "outgoing" else ("target_file", "source_file")
    mine = primary.filter(F.col("owner") == subsystem_id).select(F.col("ref_id").alias(own_side))
    edges = edges.join(mine, own_side, "left_semi")
    # The owners both ends share, once per pair of files, instead of a correlated test per edge.
    pairs = edges.select("source_file", "target_file").distinct()
    both = pairs.join(primary.select(F.col("ref_id").alias("source_file"), "owner"), "source_file").join(primary.select(F.col("ref_id").alias("target_file"), "owner"), ["target_file", "owner"]).select("source_file", "target_file", F.lit(True).alias("shares")).distinct()
    names = sections.select(F.col("id").alias("owner"), "name")
    rows = edges.join(both, ["source_file", "target_file"], "left").join(primary.withColumnRenamed("ref_id", other_side), other_side, "left").join(names, "owner", "left")
    same = F.coalesce(F.col("owner") == subsystem_id, F.lit(False))
    rows = rows.withColumn("internal", same).filter(same | F.col("shares").isNull())
    if not include_internal:
        rows = rows.filter(~F.col("internal"))
    unclassified = F.col("name").isNull() | (F.col("name") == catch_all)
    rows = rows.withColumn("unclassified", unclassified).withColumn("group", F.when(~unclassified, F.col("owner"))).withColumn("subsystem", F.when(~unclassified, F.col("name")))
    out = rows.groupBy("group", "subsystem", "unclassified", "internal").agg(
        F.count("*").alias("edges"), F.countDistinct("caller_id").alias("callers"), F.countDistinct("callee_id").alias("callees"), F.countDistinct("source_file").alias("source_files"), F.countDistinct("target_file").alias("target_files")
    )
    out = out.filter(F.col("edges") >= min_edges).select(F.lit(direction).alias("direction"), "subsystem", "edges", "callers", "callees", "source_files", "target_files", "internal", "unclassified").orderBy(F.desc("edges"), "subsystem")
    return out.limit(limit) if limit else out


def coverage(calls: DataFrame, symbols: DataFrame, claims: DataFrame | None = None, subsystem_id: int | None = None) -> DataFrame:
    """One row: edges by status, resolved and total, zeros filled in; of one section's callers if given."""
    rows = calls.select("caller_id", "resolution")
    if subsystem_id is not None:
        own = claims.filter((F.col("subsystem_id") == subsystem_id) & F.col("is_primary")).select(F.col("ref_id").alias("file_id"))
        rows = rows.join(symbols.select(F.col("id").alias("caller_id"), "file_id"), "caller_id").join(own, "file_id", "left_semi")
    return rows.agg(*[F.count_if(F.col("resolution") == s).alias(s) for s in STATUSES], F.count_if(F.col("resolution").isin(*RESOLVED)).alias("resolved"), F.count("*").alias("total"))
