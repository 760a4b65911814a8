"""Sinks: entries as JSON, CSV, plain locations or names, and the one-file record of relationships."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object a row; nulls (not applicable) are left out."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def json_text(rows: list[dict]) -> str:
    return json.dumps([{k: v for k, v in r.items() if v is not None} for r in rows], indent=2, ensure_ascii=False)


def plain(entries: DataFrame) -> DataFrame:
    """``path:line:name``; parts that don't apply are left out."""
    return entries.select(F.concat_ws(":", "path", F.col("line").cast("string"), "name").alias("value"))


def names(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("name").alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


def relationship_records(overlap: DataFrame, flow: DataFrame, coverage: DataFrame) -> DataFrame:
    """Overlaps, flows and coverage as one sparse table with a record type."""
    parts = [d.withColumn("record", F.lit(k)) for k, d in (("overlap", overlap), ("flow", flow), ("coverage", coverage))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def tree_lines(paths: list[str]) -> list[str]:
    """Sorted paths as an indented view, each directory once."""
    out, seen = [], set()
    for path in sorted(paths, key=lambda p: p.split("/")):
        parts = path.split("/")
        for k in range(len(parts)):
            key = tuple(parts[: k + 1])
            if key not in seen:
                seen.add(key)
                out.append("  " * k + parts[k] + ("/" if k < len(parts) - 1 else ""))
    return out
