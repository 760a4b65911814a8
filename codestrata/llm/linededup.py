"""Line dedup: range-partitioned line hashes, secondary sort by document and position, keep bitmaps.

A line's key is the line stripped of ``\\x20 \\x09-\\x0D`` at both ends with A-Z lower-cased. A
key of at least ``min_chars`` code points held by at least ``min_docs`` documents loses all
its lines except those of the largest doc_id that holds it.

Only hashes (128 bits) move: they are dealt by ranges of (hash, slice) and sorted by document
(largest first) and position, so the first row of each run is the occurrence to keep, and a
run is read as a stream. ``slice`` is a hash of the document, so that a line held by a third
of all documents is spread over runs of at most about ``RUN`` rows; the runs' sums then meet,
one row each. What comes back for a document is a run-length keep bitmap, not text, and only
texts that a bit table can't clear of losing lines move to meet theirs.

Defined results: null or empty text is one empty line; rows with equal doc_id count as one
document, and rows with equal doc_id and text get equal results; a null doc_id is one
document, smaller than all others; extra columns, of any names, are kept by ``dedup_lines`` and
ignored by ``line_report``; an empty table gives an empty result. Work is linear in a text's
length and number of lines. Documents that lose nothing keep their null or empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.shared import apart, fold_ascii, join_hot, materialize

MIN_CHARS, MIN_DOCS, SLICES, RUN = 40, 5, 64, 500_000
_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return fold_ascii(F.btrim(line, F.lit(_BLANK)))


def _text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, text_id, pos, h1, h2) of every line whose key is long enough."""
    # The text's hash comes before the lines: beside them it would be taken once a line.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).withColumn("text_id", _text_id(F.col("text")))
    rows = rows.select("doc", "text_id", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    rows = rows.filter(F.length("line") >= min_chars).select("doc", "text_id", "pos", line_key(F.col("line")).alias("key"))
    return rows.filter(F.length("key") >= min_chars).select("doc", "text_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64("key", F.lit(1)).alias("h2"))


def shared_lines(lines: DataFrame, min_docs: int = MIN_DOCS, slices: int = SLICES) -> DataFrame:
    """(h1, h2, keeper, n): the keys of at least min_docs documents, the largest doc that holds them, how many do."""
    by = ["h1", "h2", "slice"]
    dealt = lines.select("h1", "h2", F.pmod(F.xxhash64("doc"), F.lit(slices)).cast("int").alias("slice"), "doc", "pos")
    order = [*by, F.col("doc").desc_nulls_last(), "pos"]
    run = Window.partitionBy(*by).orderBy(F.col("doc").desc_nulls_last(), "pos")
    first = (
        dealt.repartitionByRange(*by)
        .sortWithinPartitions(*order)
        .withColumn("before", F.lag(F.struct("doc")).over(run))
        .filter(F.col("before").isNull() | ~F.col("before.doc").eqNullSafe(F.col("doc")))  # a document's first occurrence in its run
    )
    runs = first.groupBy(*by).agg(F.count("*").alias("n"), F.max("doc").alias("top"))
    return runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("keeper")).filter(F.col("n") >= min_docs)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, text_id, dropped): for documents that lose lines, the lost positions as run lengths.

    ``dropped`` is an array of structs (start, length), the maximal runs of dropped lines in
    order: the keep bitmap, run-length compressed.
    """
    lines = materialize(keyed_lines(docs, min_chars), "lines")
    total = lines.count()
    shared = materialize(shared_lines(lines, min_docs, max(SLICES, total // RUN)), "shared")
    gone = join_hot(lines, shared, ["h1", "h2"], "n", total).filter(~F.col("doc").eqNullSafe(F.col("keeper"))).select("doc", "text_id", "pos").distinct()
    at = Window.partitionBy("doc", "text_id").orderBy("pos")
    runs = gone.withColumn("run", F.col("pos") - F.row_number().over(at)).groupBy("doc", "text_id", "run").agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("length"))
    return runs.groupBy("doc", "text_id").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("dropped"))


def _marked(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(row, text, dropped): each row of docs as a struct, its text, and the runs of lines it loses (null: none)."""
    maps = materialize(keep_bitmaps(docs, min_chars, min_docs).withColumn("key", F.xxhash64("doc", "text_id")), "bitmaps")
    text = F.col("text").cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), text.alias("text"), F.col("doc_id").cast("long").alias("id"), _text_id(text).alias("tid"))
    clear, rest = apart(rows.withColumn("key", F.xxhash64("id", "tid")), "key", maps.select("key"))
    on = F.col("id").eqNullSafe(F.col("doc")) & (F.col("tid") == F.col("text_id"))
    rest = rest.drop("key").join(maps.drop("key"), on, "left").select("row", "text", "dropped")
    return clear.select("row", "text", F.lit(None).cast(rest.schema["dropped"].dataType).alias("dropped")).union(rest)


def _kept(text: Column, dropped: Column) -> Column:
    """The text without its dropped lines; dropped must be a plain column."""
    ends = F.transform(dropped, lambda r, i: F.when(i == 0, F.lit(0)).otherwise(F.get(dropped, i - 1)["start"] + F.get(dropped, i - 1)["length"]))
    gone = F.flatten(F.zip_with(dropped, ends, lambda r, end: F.concat(F.array_repeat(F.lit(False), r["start"] - end), F.array_repeat(F.lit(True), r["length"]))))
    # array_join leaves nulls out; lines after the last run have no flag.
    left = F.array_join(F.zip_with(lines_of(text), gone, lambda line, g: F.when(~F.coalesce(g, F.lit(False)), line)), "\n")
    return F.when(dropped.isNull(), F.coalesce(text, F.lit(""))).otherwise(left)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the dropped lines taken out of ``text``; all columns are kept, null text stays null."""
    marked = _marked(docs, min_chars, min_docs)
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(_kept(F.col("text"), F.col("dropped")))
    return marked.select(*(text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, kept_sha256 and keep_runs (the bitmap) of each row of docs."""
    marked = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), min_chars, min_docs)
    dropped = F.col("dropped")
    return marked.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.aggregate(dropped, F.lit(0).cast("long"), lambda a, r: a + r["length"]), F.lit(0).cast("long")).alias("n_dropped"),
        F.sha2(_kept(F.col("text"), dropped).cast("binary"), 256).alias("kept_sha256"),
        F.coalesce(F.array_join(F.transform(dropped, lambda r: F.concat_ws("+", r["start"], r["length"])), ","), F.lit("")).alias("dropped_runs"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
l AS (
  SELECT rid, doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)
),
s AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, (s.key IS NOT NULL AND l.doc_id <> s.keeper) AS dropped FROM l LEFT JOIN s USING (key)),
r AS (SELECT rid, pos, row_number() OVER (PARTITION BY rid ORDER BY pos) AS rn FROM m WHERE dropped),
g AS (SELECT rid, min(pos) - 1 AS start, count(*) AS n FROM r GROUP BY rid, pos - rn),
b AS (SELECT rid, string_agg(start || '+' || n, ',' ORDER BY start) AS dropped_runs FROM g GROUP BY rid)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256,
  coalesce(any_value(dropped_runs), '') AS dropped_runs
FROM m LEFT JOIN b USING (rid) GROUP BY rid
"""
