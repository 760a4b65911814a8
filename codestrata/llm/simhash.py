"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints: A-Z is lower-cased, words are runs other than ``\\x20 \\x09-\\x0D``, shingles are
three space-joined words (all words where there are fewer), repeats counted; bit i is 1 if
more than half of the shingles' XXH64 values (seed 42) have it. No words: fingerprint 0.

Candidates: every bit position i has a vector m(i) in {0,1}^(r+1). Each non-zero v gives a
table keyed by the bits with <m(i), v> = 1. The m(i) of r differing positions span at most r
dimensions, so some v is orthogonal to all of them and that table holds the pair under one
key: every pair within radius r meets, none is left to chance. The 64 positions take each of
the 16 vectors four times, so each of the 15 tables (r = 3) keys on exactly 32 bits.

Equal fingerprints are one node. A bucket above ``block`` members is dealt into pairs of
blocks, and what leaves a block is one star per component, never all pairs.

Defined results: null text is empty text; empty texts share fingerprint 0; rows with the same
doc_id are one node; a null doc_id gets its fingerprint and the component of what is linked to
it (null if that holds no doc_id), and links others as any row does; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.shared import apart, components, materialize, stars

SHINGLE, RADIUS, BITS, SEED = 3, 3, 64, 42


def masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius+1)-1 covering masks, unsigned."""
    size = 1 << (radius + 1)
    return [sum(1 << i for i in range(BITS) if bin((i % size) & v).count("1") % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: str, k: int) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], SEED) for s, e in zip(starts, (ends[k - 1 :] - 1).tolist())]


_BIT = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def fingerprints(texts: list[str | None], k: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprints. Bits are counted through a histogram of byte values per byte position."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        hashes = shingle_hashes(text or "", k)
        n = len(hashes)
        if not n:
            continue
        raw = np.array(hashes, np.uint64)
        if n < 400:
            ones = np.unpackbits(raw.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        else:
            raw = raw.view(np.uint8).reshape(n, 8)
            ones = np.concatenate([np.bincount(raw[:, j], minlength=256) @ _BIT for j in range(8)])
        out[i] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
    return out


def text_key(text: Column) -> Column:
    """Names a text: 128 hash bits; null and empty text are one."""
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def with_fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id long, text_key string, fp long) of each row."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2)
            for at in range(0, batch.num_rows, 512):
                fps = fingerprints(texts.slice(at, 512).to_pylist(), k)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, 512) for c in (0, 1)), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key string, fp long")


def _link_blocks(radius: int):
    """Rows (table, key, bi, bj, mine, id, fp) sorted by the first four to stars of links."""

    def one(ids, fps, mine, cross):
        if cross:
            left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
        else:
            left = right = np.arange(len(ids))
        near = np.bitwise_count(fps[left][:, None] ^ fps[right][None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        keep = ids[i] != ids[j]
        return ids[i[keep]], ids[j[keep]]

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.RecordBatch):
            key = np.stack([rows.column(c).to_numpy() for c in range(4)])
            ids, fps, mine = (rows.column(c).to_numpy(zero_copy_only=False) for c in (5, 6, 4))
            fps = fps.view(np.uint64)
            cut = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))
            size = np.diff(np.append(cut, len(ids)))
            group = np.repeat(np.arange(len(cut)), size)
            a, b = [], []
            small = (size <= 32)[group] & (key[2] == key[3])
            sid, sfp, sg = ids[small], fps[small], group[small]
            for shift in range(1, min(32, len(sid))):
                same = sg[shift:] == sg[:-shift]
                if not same.any():
                    break
                hit = same & (np.bitwise_count(sfp[shift:] ^ sfp[:-shift]) <= radius) & (sid[shift:] != sid[:-shift])
                a.append(sid[shift:][hit])
                b.append(sid[:-shift][hit])
            for g in np.flatnonzero((size > 32) | (key[2][cut] != key[3][cut])):
                at = slice(cut[g], cut[g] + size[g])
                x, y = one(ids[at], fps[at], mine[at].astype(bool), key[2][cut[g]] != key[3][cut[g]])
                if len(x):
                    x, y = stars(x, y)
                a.append(x)
                b.append(y)
            if a:
                x, y = stars(np.concatenate(a), np.concatenate(b))
                return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])
            return None

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in range(4)])
            last = np.flatnonzero((key != key[:, -1:]).any(0))
            cut = int(last[-1]) + 1 if len(last) else 0  # rows from here on may go on in the next batch
            if held and (cut or any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in range(4))):
                first = batch.slice(0, cut)
                out = flush(pa.Table.from_batches([*held, first]).combine_chunks().to_batches()[0])
                held = []
                if out is not None:
                    yield out
            elif cut:
                if (out := flush(batch.slice(0, cut))) is not None:
                    yield out
            held.append(batch.slice(cut))
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            if rows.num_rows and (out := flush(rows.to_batches()[0])) is not None:
                yield out

    return run


def links(nodes: DataFrame, radius: int = RADIUS, block: int = 1024) -> DataFrame:
    """Stars (a, b) that connect what links directly connect; nodes: (id long, fp long), fp distinct."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks(radius))])
    postings = nodes.select("id", "fp", F.explode(tables).alias("p")).select("id", "fp", "p.t", "p.key")
    shared = postings.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = (
        postings.join(shared, ["t", "key"])
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("t", "key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), (F.col("own") < F.col("other")).alias("mine"), "id", "fp")
    )
    by = ["t", "key", "bi", "bj"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_link_blocks(radius), "a long, b long")


def _classes(docs: DataFrame, k: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of each row, and (f, root, component_id) of each fingerprint: the smallest fingerprint
    of its component and the component's smallest doc_id, null if it has none."""
    fps = materialize(with_fingerprints(docs, k), "fps")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    # A doc_id repeated with other text is still one node: its fingerprints are tied.
    tied = fps.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("f1"), F.max("fp").alias("f2")).filter("f1 != f2")
    tied = fps.join(tied.select("doc_id", "f1"), "doc_id").select(F.col("fp").alias("a"), F.col("f1").alias("b"))
    roots = components(links(nodes.select(F.col("fp").alias("id"), "fp"), radius).union(tied))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("root", "fp").alias("root"), "least")
    return fps, rooted.select("f", "root").join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")


def simhash_components(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of each row of docs."""
    fps, classes = _classes(docs, k, radius)
    return fps.join(classes, F.col("fp") == F.col("f"), "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component, all columns kept: the smallest doc_id's (rows without
    doc_id come last), of several by fingerprint, text hash and the row as JSON.

    Texts stay where they are: what goes is decided on (doc_id, text hash), and only rows that a
    bit table can't clear meet the list of what goes.
    """
    fps, classes = _classes(docs, k, radius)
    # The first row of each fingerprint, then of each component; both are minima with map-side combining.
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "fp", "text_key")
    firsts = fps.groupBy("fp").agg(F.min(order).alias("first")).join(classes.select("f", "root"), F.col("fp") == F.col("f"))
    firsts = firsts.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("d"), F.col("first.text_key").alias("t"))
    keys = fps.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).withColumn("key", F.xxhash64("doc_id", "text_key"))
    kept = keys.join(firsts.withColumn("mine", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    touched = materialize(kept.filter("mine is null or n > 1").select("key", F.col("doc_id").alias("__d"), F.col("text_key").alias("__t"), F.col("mine").isNotNull().alias("__kept")), "touched")

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"))
    clear, rest = apart(rows.withColumn("key", F.xxhash64("doc_id", "text_key")), "key", touched.select("key"))
    rest = rest.drop("key").join(touched.drop("key"), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_key") == F.col("__t")), "left")
    out = clear.select("row").union(rest.filter("__kept is null").select("row"))
    if not touched.filter("__kept").isEmpty():
        out = out.union(_one_each(rest.filter("__kept").select("row", "doc_id", "text_key")))
    return out.select("row.*")


def _one_each(rows: DataFrame) -> DataFrame:
    """The first row, as JSON, of each (doc_id, text_key): rows that repeat."""
    json = F.to_json("row")
    first = rows.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(F.min(json).alias("j"))
    same = rows.join(first, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")) & (json == F.col("j")))
    return same.dropDuplicates(["doc_id", "text_key"]).select("row")
