"""Toxicity by maximum-scoring segments.

Model: token log-odds between toxic and other labelled documents with an informative Dirichlet
prior (the labelled documents' own token shares times ``PRIOR``). Tokens that are toxic
documents' own beyond chance (likelihood ratio statistic of at least ``MIN_G2``, seen in
``MIN_COUNT`` toxic documents at least) keep their score; all others share the log-odds of the rest, made slightly negative, so that the
expected score of ordinary text is below zero. A token counts once a document.

Search: a linear-time scan finds every maximal scoring segment of a text (no prefix or suffix
of one can be cut off or joined to it with gain). Calibration: with lambda the positive root of
sum p(s) exp(lambda s) = 1 over the background's scores, and K fitted to the segments found in
labelled documents that aren't toxic, K m exp(-lambda S) segments of score S are expected by
chance among m tokens. Segments expected at most ``EXPECTED`` times are toxic passages. A
document's evidence is the sum of lambda S - ln(K m) over its passages, turned into a
probability by a logistic fit on labelled documents. Labels, lang, source and doc_id are no
inputs of a score; rows with crc32(doc_id as text) mod 3 = 1 take no part in any fit.

The fit takes a bounded sample of labelled rows, the ``PER_CLASS`` of each class with the
smallest hash; that bounds the tokens of the model, all of which are kept.

Defined results: null text is empty text, which has no passage and the lowest score; null
doc_ids are not held out and have no label; a doc_id labelled twice is toxic if one label says
so; rows with equal doc_id are scored each by its text; without labels of both classes every
score is 0 (nothing is rejected); extra columns are ignored by ``report`` and kept by ``keep``;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codestrata.llm.shared import materialize

PER_CLASS, CUTOFF = 12_000, 0.7
PRIOR, MIN_G2, MIN_COUNT, EXPECTED = 1000.0, 25.0, 4, 0.05
TOKEN = re.compile(r"\w+")


@dataclass
class Model:
    scores: dict[str, float]  # positive scores by token
    drift: float  # every other token's score, negative
    lam: float = 1.0
    k: float = 0.1
    bias: float = 0.0
    slope: float = 0.0


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last token) of a text whose tokens at the
    given positions score positively and all others ``drift``. Linear in the number of hits."""
    stack: list[list] = []  # [sum before, sum after, first, last, nearest earlier one that starts lower]
    total, last = 0.0, -1
    for at, score in hits:
        total += drift * (at - last - 1)
        now = [total, total + score, at, at]
        total, last = total + score, at
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= now[0]:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= now[1]:
                stack.append([*now, j])
                break
            now = [stack[j][0], now[1], stack[j][2], now[3]]
            del stack[j:]
    return [(b - a, first, end) for a, b, first, end, _ in stack]


def found(text: str | None, model: Model) -> tuple[int, list[tuple[float, int, int]]]:
    """(number of tokens, maximal segments)."""
    words = tokens(text)
    scores = model.scores
    hits = [(i, scores[w]) for i, w in enumerate(words) if w in scores]
    return len(words), segments(hits, model.drift) if hits else []


def passages(text: str | None, model: Model) -> list[tuple[float, int, int]]:
    """The significant segments: (evidence, first token, last token)."""
    m, segs = found(text, model)
    if not segs:
        return []
    chance = math.log(max(model.k * m, 1e-300))
    return [(model.lam * s - chance, a, b) for s, a, b in segs if model.lam * s - chance >= -math.log(EXPECTED)]


def probability(evidence: float, model: Model) -> float:
    x = model.bias + model.slope * math.log1p(max(0.0, evidence))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(toxic, text) of the bounded labelled sample, exact copies of a text once, toxic if one of them is."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("id")))
    order = F.xxhash64("id")
    sample = known.filter("toxic = 1").orderBy(order, "id").limit(per_class).union(known.filter("toxic = 0").orderBy(order, "id").limit(per_class))
    sample = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("d") == F.col("id"))  # 2 * per_class rows at most
    return materialize(sample.filter("text is not null").groupBy("text").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).select("toxic", "text"), "labelled")


def _count(batches):
    """(toxic, text) rows to (token, toxic documents, other documents), summed in the task."""
    seen = {0: Counter(), 1: Counter()}
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen[toxic].update(set(tokens(text)))
    names = list(seen[0].keys() | seen[1].keys())
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.RecordBatch.from_pydict({"token": pa.array(part, pa.string()), "t": pa.array([seen[1][w] for w in part], pa.int64()), "c": pa.array([seen[0][w] for w in part], pa.int64())})


def log_odds(sample: DataFrame) -> Model | None:
    counts = materialize(sample.mapInArrow(_count, "token string, t long, c long").groupBy("token").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "counts")
    n = counts.agg(F.sum("t"), F.sum("c")).first()
    if not n[0] or not n[1]:
        return None
    nt, nc = float(n[0]), float(n[1])
    share = F.lit(PRIOR) * (F.col("t") + F.col("c")) / (nt + nc)
    odds = F.log((F.col("t") + share) / (nt + PRIOR - F.col("t") - share)) - F.log((F.col("c") + share) / (nc + PRIOR - F.col("c") - share))
    both, total = F.col("t") + F.col("c"), nt + nc

    def part(n, expected):
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    g2 = 2 * (part(F.col("t"), both * nt / total) + part(F.col("c"), both * nc / total))
    picked = counts.withColumns({"odds": odds, "g2": g2}).filter((F.col("odds") > 0) & (F.col("g2") >= MIN_G2) & (F.col("t") >= MIN_COUNT)).orderBy(F.desc("g2"), "token").collect()  # tokens of 2 * per_class documents at most
    scores = {r["token"]: float(r["odds"]) for r in picked}
    qt, qc = sum(r["t"] for r in picked) / nt, sum(r["c"] for r in picked) / nc
    rest = math.log(max(1e-9, 1 - qt) / max(1e-9, 1 - qc))
    pc = {r["token"]: (r["c"] + 0.5) / (nc + 0.5 * len(picked) + 1) for r in picked}
    mean = sum(pc[w] * s for w, s in scores.items())
    drift = min(rest, -2 * mean, -0.005)
    model = Model(scores, drift)
    model.lam = _lambda([(pc[w], s) for w, s in scores.items()], drift)
    return model


def _lambda(weights: list[tuple[float, float]], drift: float) -> float:
    """The positive root of sum p exp(lambda s) = 1."""
    if not weights:
        return 1.0
    rest = max(0.0, 1 - sum(p for p, _ in weights))

    def f(x):
        return rest * math.exp(x * drift) + sum(p * math.exp(min(600.0, x * s)) for p, s in weights) - 1

    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Bias and slope of a one-input logistic fit (Newton, ridge on the slope)."""
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], 1)
    ridge = np.diag([1e-6, 1e-2])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(0.0, w[1]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """The model, or None where labels don't show both classes."""
    sample = training_rows(docs, labels, per_class)
    model = log_odds(sample)
    if model is None:
        return None

    def scan(batches):
        for batch in batches:
            rows = [(t, *found(x, model)) for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([[s for s, _, _ in r[2]] for r in rows], pa.list_(pa.float64()))], ["toxic", "m", "scores"])

    rows = sample.mapInArrow(scan, "toxic int, m long, scores array<double>").toArrow()  # 2 * per_class rows at most
    toxic, m, scores = (rows.column(c).to_pylist() for c in range(3))
    level = float(np.median(list(model.scores.values()))) if model.scores else 1.0
    above = sum(sum(s >= level for s in x) for t, x in zip(toxic, scores) if not t)
    model.k = (above + 0.5) / max(1.0, sum(n for t, n in zip(toxic, m) if not t) * math.exp(-model.lam * level))

    def evidence(n, x):
        chance = math.log(max(model.k * n, 1e-300)) if n else 0.0
        return sum(e for s in x if (e := model.lam * s - chance) >= -math.log(EXPECTED))

    x = np.log1p(np.array([evidence(n, s) for n, s in zip(m, scores)]))
    y = np.array(toxic, float)
    # The sample takes classes apart; weighting back to their shares among all labels is a shift of the bias.
    model.bias, model.slope = _logistic(x, y)
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id").cast("long"))).groupBy("toxic").count().collect()
    share = {int(r["toxic"]): r["count"] for r in known}
    if y.sum() and (1 - y).sum() and share.get(0) and share.get(1):
        model.bias += math.log(share[1] / share[0]) - math.log(y.sum() / (1 - y).sum())
    return model


def scored(docs: DataFrame, model: Model | None, columns: list[Column]) -> DataFrame:
    """columns with ``score`` and ``passages`` (first and last token of each); columns mustn't use these names."""
    rows = docs.select(F.struct(*columns).alias("row"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("row.*", F.lit(0.0).alias("score"), F.array().cast("array<struct<evidence:double,first:int,last:int>>").alias("passages"))
    kind = pa.list_(pa.struct([("evidence", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [passages(x, model) for x in part.column(1).to_pylist()]
                score = [probability(sum(e for e, _, _ in g), model) for g in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array([[{"evidence": e, "first": a, "last": b} for e, a, b in g] for g in got], kind)], ["row", "score", "passages"])

    passage = T.StructType().add("evidence", "double").add("first", "integer").add("last", "integer")
    schema = rows.select("row").schema.add("score", "double").add("passages", T.ArrayType(passage))
    return rows.mapInArrow(run, schema).select("row.*", "score", "passages")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of each row of docs."""
    rows = scored(docs, fit(docs, labels), [F.col("doc_id").cast("long").alias("doc_id")])
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the toxic ones, all columns kept."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*own).alias("__row"), F.col("text").alias("text"))
    return scored(rows, fit(docs, labels), [F.col("__row")]).filter(F.col("score") < CUTOFF).select("__row.*")
