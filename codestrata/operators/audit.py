"""Integrity audit: every check is a table of violations, empty where the evidence holds together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata import schema
from codestrata.operators.graph import on_cycle
from codestrata.operators.paths import ancestors, directory_counts, directory_owners, parent


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key combinations that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def dangling(df: DataFrame, column: str, target: DataFrame, target_column: str = "id") -> DataFrame:
    """Rows whose reference has no target; null references are none."""
    return df.filter(F.col(column).isNotNull()).join(target.select(F.col(target_column).alias(column)), column, "left_anti")


def gaps(df: DataFrame, by: str, ordinal: str) -> DataFrame:
    """Groups whose ordinals aren't 0 to n-1, each once."""
    out = df.groupBy(by).agg(F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"), F.countDistinct(ordinal).alias("distinct"), F.count("*").alias("n"))
    return out.filter("lo != 0 or hi != n - 1 or distinct != n")


def differences(found: DataFrame, expected: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of either side that the other lacks or has with other values; nulls compare as values."""
    e = expected.select(*[F.col(k).alias(f"e_{k}") for k in keys], *[F.col(v).alias(f"e_{v}") for v in values], F.lit(True).alias("e_there"))
    f = found.select(*keys, *values).withColumn("there", F.lit(True))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in keys])
    differ = reduce(lambda a, b: a | b, [~F.col(v).eqNullSafe(F.col(f"e_{v}")) for v in values], F.lit(False))
    rows = f.join(e, on, "full_outer").filter(F.col("there").isNull() | F.col("e_there").isNull() | differ)
    return rows.select(*[F.coalesce(k, f"e_{k}").alias(k) for k in keys], *[c for v in values for c in (F.col(v), F.col(f"e_{v}").alias(f"expected_{v}"))])


def site_counts(sites: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges whose counts differ from their call sites'."""
    counted = sites.groupBy("caller_id", "callee").agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in schema.SITE_KINDS])
    return differences(calls, counted, ["caller_id", "callee"], [f"{k}_count" for k in schema.SITE_KINDS])


def bad_rows(df: DataFrame, valid: Column) -> DataFrame:
    return df.filter(~F.coalesce(valid, F.lit(False)))


def row_domains(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows outside their closed domains or with impossible values, by table."""
    c = F.col
    resolved = c("resolution").isin("same_file", "included_source", "unique_global")
    counts = c("direct_count") + c("indirect_count") + c("macro_count")
    valid = {
        "files": (c("size") >= 0) & (c("path") != ""),
        "symbols": c("kind").isin(*schema.SYMBOL_KINDS) & (c("start_line") >= 1) & (c("end_line") >= c("start_line")) & (c("name") != ""),
        "calls": c("resolution").isin(*schema.RESOLUTIONS) & (F.least("direct_count", "indirect_count", "macro_count") >= 0) & (counts > 0) & (resolved == c("callee_id").isNotNull()),
        "call_sites": c("kind").isin(*schema.SITE_KINDS) & (c("line") >= 1) & (c("byte_offset") >= 0),
        "path_subsys": (c("rank") >= 0) & c("score").isNotNull(),
        "dir_subsys": (c("n_primary") >= 0) & (c("n_primary") <= c("n_claimed")) & c("coverage").between(0.0, 1.0),
        "type_members": c("kind").isin(*schema.MEMBER_KINDS) & (c("ordinal") >= 0),
    }
    return {name: bad_rows(t[name], ok) for name, ok in valid.items() if name in t}


def paths(files: DataFrame, dirs: DataFrame) -> dict[str, DataFrame]:
    """Topology: a file's directory exists, names and depths follow from paths, extensions from names."""
    ext = F.regexp_extract("name", r"(\.[^.]+)$", 1)
    return {
        "file_directory": files.select(parent(F.col("path")).alias("path"), "id").join(dirs.select("path"), "path", "left_anti"),
        "file_name": files.filter(F.col("name") != F.element_at(F.split("path", "/"), -1)),
        "file_ext": files.filter(F.col("ext") != ext) if "ext" in files.columns else files.limit(0),
        "directory_parent": dirs.filter("path != ''").select(parent(F.col("path")).alias("path"), "id").join(dirs.select("path"), "path", "left_anti"),
        "directory_depth": dirs.filter(F.col("depth") != F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))),
    }


def ownership(files: DataFrame, claims: DataFrame, sections: DataFrame, owners: DataFrame, catch_all: str) -> dict[str, DataFrame]:
    """Ranks, co-primaries and rollups against what the claims imply."""
    by = Window.partitionBy("ref_id")
    named = claims.join(sections.select(F.col("id").alias("subsystem_id"), "name"), "subsystem_id")
    implied = named.select("ref_id", "subsystem_id", "rank", "is_primary", (F.row_number().over(by.orderBy(F.desc("score"), "name", "subsystem_id")) - 1).alias("rank2"), (F.col("score") == F.max("score").over(by)).alias("primary2"))
    return {
        "claim_rank": implied.filter("rank != rank2"),
        "claim_primary": implied.filter("is_primary != primary2"),
        "claim_gaps": gaps(claims, "ref_id", "rank"),
        "rollup": differences(owners, directory_owners(files, claims, sections, catch_all), ["path", "subsystem_id"], ["n_claimed", "n_primary", "rank"]),
    }


def directory_totals(files: DataFrame, dirs: DataFrame) -> DataFrame:
    return differences(dirs, directory_counts(files), ["path"], ["n_files", "n_subdirs", "n_files_recursive"])


def preorder(members: DataFrame) -> DataFrame:
    """Members whose parent isn't an earlier member of the same aggregate, or whose ordinals have gaps."""
    p = members.select(F.col("id").alias("parent_id"), F.col("symbol_id").alias("p_symbol"), F.col("ordinal").alias("p_ordinal"))
    wrong = members.join(p, "parent_id", "left").filter("parent_id is not null and (p_symbol is null or p_symbol != symbol_id or p_ordinal >= ordinal)").select("symbol_id")
    return wrong.union(gaps(members, "symbol_id", "ordinal").select("symbol_id")).distinct()


def sites_in_spans(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call sites outside their caller's lines."""
    return sites.join(symbols.select(F.col("id").alias("caller_id"), "start_line", "end_line"), "caller_id").filter(~F.col("line").between(F.col("start_line"), F.col("end_line")))


def includes(edges: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    return {
        "includer": dangling(edges, "includer_id", files),
        "included": dangling(edges, "included_id", files),
        "self": edges.filter("includer_id = included_id"),
        "cycle": on_cycle(edges.select(F.col("includer_id").alias("src"), F.col("included_id").alias("dst"))),
    }


def outcomes(calls: DataFrame, symbols: DataFrame, expected: DataFrame) -> DataFrame:
    """Direct calls whose recorded identity differs from what resolve() derives again."""
    rows = calls.filter("direct_count > 0").join(symbols.select(F.col("id").alias("caller_id"), F.col("file_id").alias("caller_file_id")), "caller_id")
    e = expected.select("caller_file_id", F.col("name").alias("callee"), F.col("resolution").alias("r2"), F.col("callee_id").alias("id2"))
    return rows.join(e, ["caller_file_id", "callee"], "left").filter(~F.col("resolution").eqNullSafe(F.col("r2")) | ~F.col("callee_id").eqNullSafe(F.col("id2")))


def violations(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n) of every check, in one job."""
    return reduce(lambda a, b: a.union(b), [df.agg(F.lit(k).alias("check"), F.count("*").alias("n")) for k, df in checks.items()])


__all__ = ["ancestors", "violations"]
