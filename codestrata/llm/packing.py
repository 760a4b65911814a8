"""Pattern packing: as few sequences of at most ``capacity`` tokens as can be.

A document is its token ids and an end id. Longer ones are cut into pieces of ``capacity``
tokens, the first piece taking what is left over, so every document has at most one piece
that doesn't fill a sequence. Pieces are then only lengths: a histogram of at most
``capacity`` counts, which is all the driver sees, however many documents there are.

The plan: patterns of one, two or three lengths that fill a sequence exactly are enumerated,
their repeat counts are fitted to the histogram by non-negative least squares (projected
gradient with momentum; long lengths weigh more, as what stays over of them costs most), a share
of them is rounded down and held within what is left of each length, and what stays over is
packed best fit, longest first, on counts. Of the shares in ``SHARES``, the one that leaves
the fewest sequences is taken: exact patterns use up the short lengths that best fit needs. A
share of nothing is among them, so a plan never needs more than best fit alone. The plan is a list of runs: pattern p
repeated c times gives each of its slots c consecutive ranks of its length. Documents find
their slot by their rank among pieces of equal length, which is a task's first rank plus a
running count within the task, so no length, however common, meets in one task.

Defined results: null text is an empty text (one end token); every row is a document of its
own, repeated rows too; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.shared import materialize

CAPACITY, END = 1024, 2
SHARES = (1.0, 0.7, 0.4, 0.2, 0.0)
TOKENIZER = "byte_bpe_50k.json"
#: Fixed value: how byte-level tokenizers split texts before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def _fast(path: str):
    """The vocabulary file as rank table for the quicker library, or None where ids may differ.

    They can't differ for byte-level BPE whose merges are numbered in order after the bytes.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if model["type"] != "BPE" or not plain:
        return None
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    to_byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    if [vocab.get(m) for m in merges] != list(range(256, 256 + len(merges))) or len(vocab) != 256 + len(merges):
        return None
    ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in vocab.items()}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Token ids of texts, as the tokenizers library gives them. Texts are cut at single spaces
    between other characters, where the tokenizer's own split always falls; parts that came
    before are remembered. Texts that hold a special token's string go through the library whole."""

    MOST, LONGEST = 300_000, 32

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.one = _fast(path) or self._whole
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def parts(text: str) -> list[str]:
        cut = text.split(" ")
        if any(not p or p[0].isspace() or p[-1].isspace() for p in cut):
            joined, open_ = [], False  # a space beside white space is no cut
            for p in cut:
                if joined and (open_ or not p or p[0].isspace()):
                    joined[-1] += " " + p
                elif joined:
                    joined.append(" " + p)
                else:
                    joined.append(p)
                open_ = not p or p[-1].isspace()
            return joined
        return [cut[0], *[" " + p for p in cut[1:]]]

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if any(t in text for t in self.special):
            return np.array(self._whole(text), "<u4").tobytes()
        known, one, out = self.known, self.one, []
        for part in self.parts(text):
            ids = known.get(part)
            if ids is None:
                ids = array("I", one(part)).tobytes()
                if len(part) <= self.LONGEST and len(known) < self.MOST:  # what comes first is what comes often
                    known[part] = ids
            out.append(ids)
        return b"".join(out)


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of every row, with the task that cut it and its running number among the task's pieces of that length."""
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        encode, task, seen = Encoder(tokenizer_path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(at, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(text or "") + last
                    n, start, view = len(ids) // 4, 0, memoryview(ids)
                    sizes = [n] if n <= capacity else [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)
                    for k, size in enumerate(sizes):
                        rows.append((doc, k, start, size, zlib.crc32(view[4 * start : 4 * (start + size)]), task, int(seen[size])))
                        seen[size] += 1
                        start += size
                if rows:
                    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def patterns(lengths: np.ndarray, capacity: int, most: int = 200_000) -> np.ndarray:
    """Exactly filling patterns of the given lengths: rows (a, b, c) with a >= b >= c, 0 for an empty slot."""
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    rows = [np.array([[capacity, 0, 0]])] if have[capacity] else []
    a = np.arange((capacity + 1) // 2, capacity)
    a = a[have[a] & have[capacity - a]]
    rows.append(np.stack([a, capacity - a, 0 * a], 1))
    x, y = np.meshgrid(lengths, lengths, indexing="ij")
    z = capacity - x - y
    ok = (x >= y) & (y >= z) & (z >= 1)
    ok[ok] = have[z[ok]]
    triples = np.stack([x[ok], y[ok], z[ok]], 1)
    rows.append(triples[:: max(1, -(-len(triples) // most))])
    return np.concatenate(rows).astype(np.int64)


def fit(hist: np.ndarray, rows: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative repeat counts x minimising the squared distance of the lengths used to hist, weighted by length."""
    size, total = len(hist), max(1.0, float(hist.sum()))
    target, weight = hist / total, np.arange(size) / size

    def used(x):
        out = np.zeros(size)
        for k in range(3):
            out += np.bincount(rows[:, k], x, size)
        out[0] = 0
        return out

    def back(r):
        r = r * weight
        return r[rows[:, 0]] + r[rows[:, 1]] + r[rows[:, 2]]

    v = np.ones(len(rows))
    for _ in range(20):
        v = back(used(v))
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    step = 1.0 / (norm * 1.05)
    x = z = np.zeros(len(rows))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - step * back(used(z) - target))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x * total


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats): sequences that together use every piece of the histogram exactly once."""
    hist = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        hist[length] = n
    rows = patterns(np.flatnonzero(hist), capacity)
    x = fit(hist.astype(float), rows) if len(rows) else np.zeros(0)
    plans = [_rounded(hist.copy(), rows, np.floor(share * x + 1e-9).astype(np.int64), capacity) for share in SHARES]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def _rounded(left: np.ndarray, rows: np.ndarray, x: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """x repeats of each pattern, as far as ``left`` has the lengths, and the rest by best fit."""
    plan: list[tuple[tuple[int, ...], int]] = []
    for i in np.argsort(-x, kind="stable"):
        if x[i] <= 0:
            break
        row = rows[i][rows[i] > 0]
        n = min(int(x[i]), *(int(left[k] // (row == k).sum()) for k in row))
        if n > 0:
            plan.append((tuple(int(k) for k in row), n))
            for k in row:
                left[k] -= n
    # Best fit, longest first, on counts: a bin is known by its lengths and room.
    bins: dict[int, dict[tuple[int, ...], int]] = {}
    for length in range(capacity, 0, -1):
        while (n := int(left[length])) > 0:
            room = next((r for r in range(length, capacity + 1) if bins.get(r)), None)
            if room is None:
                per = min(n, max(1, capacity // length))
                full, rest = divmod(n, per)
                for many, size in ((full, per), (1, rest)):
                    if many and size:
                        shape = bins.setdefault(capacity - length * size, {})
                        key = (length,) * size
                        shape[key] = shape.get(key, 0) + many
                left[length] = 0
                break
            key = next(iter(bins[room]))
            have, per = bins[room][key], room // length  # the tightest bin is filled as far as it goes, then the next
            for many, size in ((min(have, n // per), per), (1 if n // per < have else 0, n % per)):
                if many and size:
                    bins[room][key] -= many
                    shape = bins.setdefault(room - length * size, {})
                    grown = (*key, *(length,) * size)
                    shape[grown] = shape.get(grown, 0) + many
                    left[length] -= many * size
            if not bins[room][key]:
                del bins[room][key]
    plan += [(key, n) for shapes in bins.values() for key, n in shapes.items()]
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """The plan by slot, sorted by (length, first rank): length, rank, sequence, offset."""
    out, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, n in plan:
        offset = 0
        for k in lengths:
            out.append((k, int(used[k]), sequence, offset))
            used[k] += n
            offset += k
        sequence += n
    table = np.array(sorted(out), np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs."""
    spark = docs.sparkSession
    pieces = materialize(pieces_of(docs, tokenizer_path, capacity, end), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    by_task = materialize(by_task, "counts")
    hist = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(slots(make_plan(hist, capacity), capacity))  # bounded by the patterns, not by the documents
    first = by_task.select(F.col("length").alias("l"), F.col("task").alias("t"), (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = pieces.join(first, (F.col("length") == F.col("l")) & (F.col("task") == F.col("t"))).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches):
        table = plan.value
        key = table["length"] * (1 << 44) + table["rank"]
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(key, batch.column(3).to_numpy() * (1 << 44) + rank, side="right") - 1
            sequence = table["sequence"][at] + rank - table["rank"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(table["offset"][at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
