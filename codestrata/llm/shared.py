"""What several operators of this subpackage need: shared storage, text expressions, joins that
leave most rows where they are, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.functions.storage import fresh_path, materialize, materialize_at, remove

__all__ = ["apart", "components", "fold_ascii", "fresh_path", "join_hot", "materialize", "stars", "word_count"]

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A sieve's words of 64 bits, at most: 262,144 rows of two numbers are broadcast, however many keys there are.
SIEVE_WORDS = 1 << 18
#: A key that holds over one in so many rows is hot: there are fewer hot keys than this.
HOT_SHARE = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_ascii(c: Column) -> Column:
    """A-Z lower-cased, nothing else changed."""
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def apart(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows split into those whose hash ``key`` is surely not among the hashes of keys (key long), and the others.

    keys is read twice, so it should be written. A bit table of fixed size decides: it has no
    false negatives, so only rows of the second part need the join with keys, and only those
    move. With very many keys the table fills up and the second part grows to all rows.
    """
    words = 1 << max(4, min(SIEVE_WORDS.bit_length() - 1, (keys.count() // 4).bit_length()))  # 16 bits a key
    slot, k = (lambda h: F.pmod(F.shiftrightunsigned(h, 6), F.lit(words))), keys.columns[0]
    sieve = keys.select(slot(F.col(k)).alias("__slot"), F.expr(f"shiftleft(1L, cast({k} & 63 as int))").alias("__one")).groupBy("__slot").agg(F.bit_or("__one").alias("__bits"))
    marked = rows.withColumn("__at", slot(F.col(key))).join(F.broadcast(sieve), F.col("__at") == F.col("__slot"), "left")
    marked = marked.withColumn("__maybe", F.coalesce(F.expr(f"shiftrightunsigned(__bits, cast({key} & 63 as int)) & 1") == 1, F.lit(False)))
    return marked.filter("not __maybe").select(*rows.columns), marked.filter("__maybe").select(*rows.columns)


def join_hot(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """The inner or left join of left with right, whose keys are unique and have ``n`` rows each in left, of ``total`` altogether.

    Keys with over total / HOT_SHARE rows, fewer than HOT_SHARE therefore, are broadcast: their
    rows stay where they are. No other key is large enough to hold a task up. Both are read twice.
    """
    hot = right.filter(F.col(n) > total / HOT_SHARE)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(right.filter(F.col(n) <= total / HOT_SHARE), on, how)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges a[i]-b[i] as (node, smallest node of its component), roots left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lu, lv = label[u], label[v]
        differ = lu != lv
        if not differ.any():
            break
        np.minimum.at(label, np.maximum(lu, lv)[differ], np.minimum(lu, lv)[differ])
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): a row (node, root) per node that isn't its component's smallest.

    Alternates large-star and small-star steps until nothing changes. Every step is a
    minimum with map-side combining and a join, so no node's neighbours meet in one task.
    Each round is written to the shared folder; the one before it is removed.
    """
    spark = edges.sparkSession
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    now_path = fresh_path(spark, "edges")
    now = materialize_at(edges.filter("a != b").select(hi.alias("a"), lo.alias("b")).distinct(), now_path)

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000003), F.sum(F.xxhash64("b", "a") % 999983)).first()

    was = mark(now)
    while was[0]:
        before = now
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low, F.col("a") == F.col("k"))
        small = small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("k").alias("a"), F.col("m").alias("b")))
        next_path = fresh_path(spark, "edges")
        now = materialize_at(small.distinct(), next_path)
        is_ = mark(now)
        # Equal sums only suggest that nothing changed; equal sizes and no new edge prove it.
        same = is_ == was and now.join(before, ["a", "b"], "left_anti").isEmpty()
        remove(spark, now_path)
        now_path = next_path
        if same:
            break
        was = is_
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
