"""Directory trees from paths: ancestors, directories and rollups, without recursion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.text import ascii_fold, depth, ratio


def parent(path: Column) -> Column:
    """The containing directory; the root is the empty path."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def ancestors(path: Column) -> Column:
    """All containing directories of a path, the root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def under(path: Column, directory: str) -> Column:
    """Literal, case-sensitive test for a descendant of directory; everything is below the root."""
    return F.lit(True) if directory == "" else path.startswith(directory + "/")


def directories(files: DataFrame) -> DataFrame:
    """(id, path, parent_id, name, depth) of every directory that holds files, the root included.

    Ids are dense in breadth-first order with sorted children: array order of the split path within a depth.
    """
    paths = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    rows = paths.select("path", F.when(F.col("path") == "", 0).otherwise(depth(F.col("path")) + 1).alias("depth"))
    ids = rows.withColumn("id", F.row_number().over(Window.orderBy("depth", F.split("path", "/"))).cast("long"))
    up = ids.select(F.col("path").alias("up"), F.col("id").alias("parent_id"))
    joined = ids.join(up, (parent(F.col("path")) == F.col("up")) & (F.col("path") != ""), "left")
    return joined.select("id", "path", "parent_id", F.element_at(F.split("path", "/"), -1).alias("name"), "depth")


def directory_counts(files: DataFrame) -> DataFrame:
    """(path, n_files, n_subdirs, n_files_recursive): direct files, direct subdirectories, all files below."""
    below = files.select("id", F.explode(ancestors(F.col("path"))).alias("dir"), parent(F.col("path")).alias("own"))
    counts = below.groupBy("dir").agg(F.count_if(F.col("dir") == F.col("own")).alias("n_files"), F.count("*").alias("n_files_recursive"))
    subs = counts.filter("dir != ''").groupBy(parent(F.col("dir")).alias("up")).agg(F.count("*").alias("n_subdirs"))
    return counts.join(subs, F.col("dir") == F.col("up"), "left").select(F.col("dir").alias("path"), "n_files", F.coalesce("n_subdirs", F.lit(0)).alias("n_subdirs"), "n_files_recursive")


def rank_claims(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """Claims (ref_id, subsystem_id, score) with rank and is_primary: ties for the best score stay tied."""
    named = claims.join(sections.select(F.col("id").alias("subsystem_id"), "name"), "subsystem_id")
    by = Window.partitionBy("ref_id")
    return named.select(
        "ref_id",
        "subsystem_id",
        "score",
        (F.row_number().over(by.orderBy(F.desc("score"), "name", "subsystem_id")) - 1).alias("rank"),
        (F.col("score") == F.max("score").over(by)).alias("is_primary"),
    )


def directory_owners(files: DataFrame, claims: DataFrame, sections: DataFrame, catch_all: str) -> DataFrame:
    """(path, subsystem_id, n_claimed, n_primary, coverage, rank): each directory's owners over all files below it."""
    below = files.select("id", F.explode(ancestors(F.col("path"))).alias("path"))
    totals = below.groupBy("path").agg(F.count("*").alias("total"))
    per = below.join(claims, F.col("id") == F.col("ref_id")).groupBy("path", "subsystem_id").agg(F.count("*").alias("n_claimed"), F.count_if("is_primary").alias("n_primary"))
    named = per.join(sections.select(F.col("id").alias("subsystem_id"), "name"), "subsystem_id").join(totals, "path")
    order = Window.partitionBy("path").orderBy(F.col("name") == catch_all, F.desc("n_primary"), F.desc("n_claimed"), "name", "subsystem_id")
    return named.select("path", "subsystem_id", "n_claimed", "n_primary", ratio(F.col("n_primary"), F.col("total")).alias("coverage"), (F.row_number().over(order) - 1).alias("rank"))


def section_counts(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """(id, name, n_files, n_primary_files), sections without claims included."""
    n = claims.groupBy("subsystem_id").agg(F.count("*").alias("n_files"), F.count_if("is_primary").alias("n_primary_files"))
    rows = sections.select("id", "name").join(n, F.col("id") == F.col("subsystem_id"), "left")
    return rows.select("id", "name", F.coalesce("n_files", F.lit(0)).alias("n_files"), F.coalesce("n_primary_files", F.lit(0)).alias("n_primary_files"))


def top_areas(files: DataFrame, symbols: DataFrame, limit: int = 8) -> DataFrame:
    """The top-level directories with most symbols; an equality on the first component instead of a prefix join."""
    area = files.filter(F.col("path").contains("/")).select(F.col("id").alias("file_id"), F.split("path", "/")[0].alias("area"))
    return symbols.join(area, "file_id").groupBy("area").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "area").limit(limit)


def name_order(name: str = "name") -> Column:
    return ascii_fold(F.col(name))
