"""Mixing sources to target weights by hash-threshold histograms.

A source's target T against its size S (words) says how often its documents go in: all of
them floor(T / S) times, and a share of them once more. That share is a budget of words,
filled by nested thresholds on a document's hash: sizes are summed by source and hash bucket,
the running sum finds the bucket where the budget ends, and only that boundary bucket is
summed again by its next hash bits, three times over. Documents are then filtered by
comparing their hash with their source's threshold: nothing is sorted, no document moves, and
a hot source is 4096 partial sums. As the order is the hash, a larger budget takes a superset.

Targets: sources by code point, null last, weigh 5, 2, 1 and again; they share ``share`` times
all words. A target stops at ``most`` times its source's size and the excess is shared again
by weight until none is above. Solved in one pass: the targets are min(most * S, x * weight),
and sorting by S / weight gives x from running sums.

Defined results: null text has size 0; null sources are one source; documents with equal
doc_id share their hash; a null doc_id is hashed as the empty string; extra columns, of any
names, are kept by ``mix``; a source of size 0 has target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.shared import materialize, word_count

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BITS, LEVELS = 12, 3
#: Sources whose plan is broadcast: 50,000 rows of names and five numbers.
BROADCAST = 50_000


def draw(doc_id: Column) -> Column:
    """36 hash bits of a document: the first nine hex digits of the MD5 of its doc_id's text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def _digit(u: Column, level: int) -> Column:
    return F.shiftright(u, BITS * (LEVELS - level)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row per source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    capped = sizes.select("source", "source_size").withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    whole, upto = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    s = (
        capped.withColumn("budget", F.sum("source_size").over(whole) * float(share))
        .withColumn("all_w", F.sum("w").over(whole))
        .withColumn("x", (F.col("budget") - (F.sum("cap").over(upto) - F.col("cap"))) / (F.col("all_w") - (F.sum("w").over(upto) - F.col("w"))))
        .withColumn("x", F.max(F.when(F.col("x") * F.col("w") <= F.col("cap"), F.col("x"))).over(whole))
    )
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("x") * F.col("w"), F.col("cap"))).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, whole, cut): every document goes in ``whole`` times, and once more if its draw is below ``cut``."""
    state = goals.select(F.col("source").alias("s"), F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("whole"), "source_size", "target")
    state = state.select("s", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix"))
    for level in range(1, LEVELS + 1):
        part = rows.select("source", "size", _digit(F.col("u"), level).alias("b"))
        known = state.select("s", F.col("prefix").alias("p"))
        if level > 1:  # the boundary bucket of the level above, a row per source
            part = part.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("b", BITS) == F.col("p"))).select("source", "size", "b")
        sums = part.groupBy("source", "b").agg(F.sum("size").alias("n"))
        before = Window.partitionBy("source").orderBy("b")
        sums = sums.withColumn("upto", F.sum("n").over(before))
        at = sums.join(state.select("s", "left"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        below = at.groupBy("source").agg(
            F.coalesce(F.sum(F.when(F.col("upto") <= F.col("left"), F.col("n"))), F.lit(0)).alias("taken"),
            F.min(F.when(F.col("upto") > F.col("left"), F.col("b"))).alias("edge"),
            F.min_by(F.when(F.col("upto") > F.col("left"), F.col("n")), F.when(F.col("upto") > F.col("left"), F.col("b"))).alias("edge_n"),
        )
        end = F.shiftleft(F.col("prefix") + 1, BITS)
        # What shares the last boundary hash goes in if that comes nearer to the budget.
        nearest = F.when(2 * (F.col("left") - F.coalesce("taken", F.lit(0))) >= F.col("edge_n"), 1).otherwise(0)
        state = materialize(
            state.join(below, F.col("s").eqNullSafe(F.col("source")), "left").select("s", "whole", (F.col("left") - F.coalesce("taken", F.lit(0))).alias("left"), (F.coalesce("edge", end) + (nearest if level == LEVELS else 0)).cast("long").alias("prefix")),
            f"level{level}",
        )
    return state.select(F.col("s").alias("source"), "whole", F.col("prefix").alias("cut"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, u, size) of each row; texts are read once, for this."""
    return materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), draw(F.col("doc_id")).alias("u"), word_count(F.col("text").cast("string")).alias("size")), "sizes")


def plan(rows: DataFrame, **how) -> DataFrame:
    """(source, source_size, target, whole, cut), one row per source, of what sized() returns."""
    goals = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **how), "targets")
    cuts = thresholds(rows, goals).withColumnRenamed("source", "s")
    return goals.join(cuts, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _with_copies(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """(row, source_size, target, copies): docs' rows as structs. sources has a row per source; up to BROADCAST
    of them are broadcast, so that no text moves; more are joined by source."""
    sources = materialize(sources, "plan")
    if sources.count() <= BROADCAST:
        sources = F.broadcast(sources)
    p = sources.select(F.col("source").alias("s"), "source_size", "target", "whole", "cut")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("source").cast("string").alias("of"), draw(F.col("doc_id")).alias("u"))
    joined = rows.join(p, F.col("of").eqNullSafe(F.col("s")), "left")
    return joined.select("row", "source_size", "target", (F.col("whole") + F.when(F.col("u") < F.col("cut"), 1).otherwise(0)).cast("int").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix: each row of docs as often as it goes in (0, 1 or 2 times), all columns kept."""
    rows = _with_copies(docs, plan(sized(docs), **how)).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of each row of docs."""
    narrow = sized(docs)
    rows = _with_copies(narrow, plan(narrow, **how))
    return rows.select("row.doc_id", "row.size", "source_size", "target", (F.col("row.size") * F.col("copies")).alias("taken"), "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 9))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget, sum(w) OVER () AS all_w FROM w),
x AS (SELECT *, (budget - (sum(cap) OVER o - cap)) / (all_w - (sum(w) OVER o - w)) AS x FROM c WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST)),
t AS (SELECT source, source_size, least(cap, coalesce(w * (SELECT max(y.x) FROM x AS y WHERE y.x * y.w <= y.cap), cap)) AS target FROM x),
q AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::INT AS whole,
    sum(size) OVER (PARTITION BY d.source ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER (PARTITION BY d.source, u) AS n
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (whole + extra))::BIGINT AS taken, (whole + extra)::INT AS copies
FROM (SELECT *, CASE WHEN upto <= target - whole * source_size OR 2 * (target - whole * source_size - (upto - n)) >= n THEN 1 ELSE 0 END AS extra FROM q)
"""
