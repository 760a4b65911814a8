"""Questions across snapshots: one table with a version column, each version ranked for itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.operators.targets import definition_order, symbol_targets


def versioned(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("version", F.lit(v)) for v, df in tables.items()])


def locate(symbols: DataFrame, files: DataFrame, name: str, versions: list[str]) -> DataFrame:
    """(version, found, path, line, candidates): where each version defines a name; versions without it are rows, too.

    symbols and files have a version column; definitions are ranked within their version.
    """
    rows = symbols.filter(F.col("name") == name).join(files.select(F.col("id").alias("file_id"), "path", "version"), ["file_id", "version"])
    rows = rows.withColumnsRenamed({"kind": "symbol_kind", "start_line": "line"})
    by = Window.partitionBy("version")
    best = rows.withColumn("at", F.row_number().over(by.orderBy(*definition_order()))).withColumn("candidates", F.count("*").over(by)).filter("at = 1")
    known = symbols.sparkSession.createDataFrame([(v,) for v in versions], "version string")
    return known.join(best.select("version", "path", "line", "candidates"), "version", "left").select("version", F.col("path").isNotNull().alias("found"), "path", "line", F.coalesce("candidates", F.lit(0)).alias("candidates"))


__all__ = ["versioned", "locate", "symbol_targets"]
