"""Written intermediate tables in the folder all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: str | None = None
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and the driver is the only machine."""
    global _own_dir
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="codestrata-")
    return f"file://{_own_dir}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is under it goes when the driver ends."""
    path = f"{shared_dir(spark)}/codestrata/{uuid.uuid4().hex}/{name}"
    if not _written:
        atexit.register(_clear)
    _written.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table is still there."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def _clear() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the JVM may have ended first
            return


def materialize_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, and survives lost executors."""
    return materialize_at(df, fresh_path(df.sparkSession, name))


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """df, written, with ``id``: dense numbers from 1 in the given order, which must tell all rows apart.

    Rows are dealt by ranges of the order and numbered within their range; what lies before a
    range is a running sum over one row a range, so no task sorts the whole table.
    """
    ranged = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    rows = materialize(ranged, name)  # the range is read back, not taken again
    sizes = sorted((r["__range"], r["n"]) for r in rows.groupBy("__range").agg(F.count("*").alias("n")).collect())
    before, sums = 0, []
    for k, n in sizes:
        sums.append((k, before))
        before += n
    starts = df.sparkSession.createDataFrame(sums, "__of int, __before long")  # a row per range
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return rows.withColumn("__nth", nth).join(F.broadcast(starts), F.col("__range") == F.col("__of")).withColumn("id", F.col("__nth") + F.col("__before")).select(*df.columns, "id")
