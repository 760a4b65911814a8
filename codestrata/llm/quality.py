"""Quality rules with risk-controlled thresholds.

Base statistics of a text (null: no words): words are runs other than ``\\x20 \\x09-\\x0D``;
n_words; word_chars, code points in words; n_symbols, characters of ``#*$%&|<>``; n_dup_lines,
lines with a word that equal an earlier line; n_repeat_words, words in three-word windows found
twice or more in the text, first included. A text fails the base rules below ``MIN_WORDS``
words or where over half of its words repeat.

Rules compare one ratio each with a cutoff from a fixed grid. A filter is a cutoff, or none, per
rule, and rejects what any rule rejects. Strata are languages; those without ``MIN_LABELLED``
labelled good documents to test on form one stratum (null).

Thresholds, per stratum: the labelled documents that pass the base rules are split in half by a
hash of doc_id. The design half fixes a sequence of filters, each stricter than the one before:
step by step the cutoff that catches most further bad documents over good ones. The other half,
the holdout, tests them in this order: a filter passes if the exact binomial (Clopper-Pearson) upper bound of its share of good
documents rejected is at most ``RISK``; the first that fails ends the test, and the last that
passed is used. As the sequence is fixed before the holdout is looked at, and a filter is only
tested if all laxer ones passed, the whole sequence is one test (fixed-sequence testing); over
strata the confidence is divided by their number (Bonferroni). So with probability 1 - ``DELTA``
the filters used reject, in every stratum at once, at most ``RISK`` of the good documents that
pass the base rules, whatever the design half looked like. Bounds are on the whole filter, so nothing
is lost by sharing the risk out to rules.

All labelled documents count. Of the design half the driver gets a row, with its number of
documents, per combination of cutoffs passed that occurs in a stratum: no more than the grid has,
however many documents there are. Of the holdout it gets a row per stratum and step.

Defined results: unlabelled documents and null labels take no part in the fit; a document with
several labels is good if all of them are; without labels only the base rules hold; a null
doc_id has no label; repeated rows count each; extra columns are ignored; an empty table gives
an empty result. Work is linear in a text's length but for a sort of its window hashes. ``fit`` takes written
statistics: filters on the unwritten plan would be pushed down through every step of it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.shared import SPACE, materialize

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
RISK, DELTA, MIN_LABELLED, STEPS = 0.05, 0.05, 100, 16
#: A rule rejects where its ratio is above (or, for "short_words", below) the cutoff; strictest first.
GRID = {
    "symbols": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3],  # n_symbols / (word_chars + 1)
    "dup_lines": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5],  # n_dup_lines / (n_lines with a word + 1)
    "repeats": [0.02, 0.05, 0.1, 0.2, 0.3, 0.4],  # n_repeat_words / (n_words + 1)
    "long_words": [6.5, 7.0, 8.0, 9.0, 10.0, 12.0],  # word_chars / (n_words + 1)
    "short_words": [4.5, 4.0, 3.5, 3.0, 2.5, 2.0],
    "pipes": [0.02, 0.05, 0.1, 0.2],  # words that are one symbol / (n_words + 1)
    "shouting": [0.05, 0.1, 0.2, 0.3, 0.5],  # A-Z / (word_chars + 1)
}
SYMBOLS = "#*$%&|<>"


def _without(c: Column, chars: str) -> Column:
    for ch in chars:
        c = F.replace(c, F.lit(ch), F.lit(""))
    return c


def statistics(docs: DataFrame) -> DataFrame:
    """The base statistics of each row, with doc_id and lang, computed inside the row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"))
    trimmed = F.btrim("text", F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    rows = rows.withColumn("words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))).withColumn("n", F.size("words"))
    rows = rows.withColumn("solid", _without(F.col("text"), "\x20\x09\x0a\x0b\x0c\x0d")).withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit("\x20\x09\x0b\x0c\x0d")) != ""))
    # Windows whose hashes differ differ; those whose hashes meet are compared as texts. A hash and its place are
    # sorted as one number: as many low bits hold the place as the text's size needs. (Arrays without nulls sort as numbers.)
    windows = F.transform("words", lambda w, i: F.coalesce(F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)), F.lit(0).cast("long")))
    rows = rows.withColumn("win", F.slice(windows, 1, F.greatest(F.lit(0), F.col("n") - 2))).withColumn("twice", F.size("win") != F.size(F.array_distinct("win"))).withColumn("bits", F.length(F.bin("n")).cast("int"))
    packed = F.transform("win", lambda h, i: F.coalesce(F.call_function("shiftleft", h, F.col("bits")).bitwiseOR(i.cast("long")), F.lit(0).cast("long")))
    rows = rows.withColumn("order", F.when(F.col("twice"), F.sort_array(packed)))
    top = lambda x: F.call_function("shiftrightunsigned", x, F.col("bits"))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1).cast("int")
    at = F.filter("order", lambda x, k: (F.coalesce(top(x) == top(F.get("order", k - 1)), F.lit(False))) | F.coalesce(top(x) == top(F.get("order", k + 1)), F.lit(False)))
    rows = rows.withColumn("met", F.transform(at, place))
    told = F.transform("met", lambda i: F.struct(F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("w"), i.alias("i")))
    rows = rows.withColumn("told", F.when(F.size("met") > 0, F.sort_array(told)))
    alike = F.filter("told", lambda x, k: F.coalesce(x["w"] == F.get("told", k - 1)["w"], F.lit(False)) | F.coalesce(x["w"] == F.get("told", k + 1)["w"], F.lit(False)))
    rows = rows.withColumn("hit", F.sort_array(F.transform(alike, lambda x: x["i"])))
    # Each marked window adds the words that the marked window before it has not covered.
    covered = F.aggregate(
        "hit",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return rows.select(
        "doc_id",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        F.length("solid").cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.length(w) == 1)).cast("long").alias("n_single"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def ratios() -> dict[str, Column]:
    words, chars = F.col("n_words") + 1, F.col("word_chars") + 1
    return {
        "symbols": F.col("n_symbols") / chars,
        "dup_lines": F.col("n_dup_lines") / (F.col("n_lines") + 1),
        "repeats": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
        "short_words": F.col("word_chars") / words,
        "pipes": F.col("n_single") / words,
        "shouting": F.col("n_upper") / chars,
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exact up to rounding."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    a, b, c = math.lgamma(n + 1), math.log(p), math.log1p(-p)
    return min(1.0, math.fsum(math.exp(a - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * b + (n - i) * c) for i in range(k + 1)))


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the rate at which k or fewer of n still has probability delta."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_tail(k, n, mid) > delta else (lo, mid)
    return hi


def sequence_of(ratios: np.ndarray, good: np.ndarray, steps: int = STEPS, risk: float = RISK, n: np.ndarray | None = None) -> list[tuple[str, float]]:
    """The design half's sequence of (rule, cutoff) steps: ratios has a column per rule of GRID, n the documents a row stands for (one).

    Step by step the cutoff that catches most bad documents more than good ones beyond the steps
    before; of equals the one with more bad, then the laxer, then the first rule. It ends where no
    cutoff catches more bad than good, or where good ones lost come to twice the risk.
    """
    out: list[tuple[str, float]] = []
    gone = np.zeros(len(good), bool)
    n = np.ones(len(good), np.int64) if n is None else n
    hits = []
    for j, (rule, cutoffs) in enumerate(GRID.items()):
        for k, cutoff in enumerate(cutoffs):
            hits.append((rule, cutoff, -k, -j, ratios[:, j] < cutoff if rule == "short_words" else ratios[:, j] > cutoff))
    while len(out) < steps:
        best = max(((int(n[h & ~gone & ~good].sum()), int(n[h & ~gone & good].sum()), lax, j, rule, cutoff, h) for rule, cutoff, lax, j, h in hits), key=lambda x: (x[0] - x[1], x[0], -x[2], x[3]))
        if best[0] <= best[1] or n[(gone | best[6]) & good].sum() > 2 * risk * max(1, n[good].sum()):
            break
        gone |= best[6]
        out.append((best[4], best[5]))
    return out


def steps_passed(good: int, rejected: list[int], risk: float, delta: float) -> int:
    """How many of the sequence's filters pass: rejected holds, per filter, how many of the holdout's good documents it rejects."""
    for k, lost in enumerate(rejected):
        if not good or upper_bound(lost, good, delta) > risk:
            return k
    return len(rejected)


def held_half(doc_id: Column) -> Column:
    """Whether a labelled document belongs to the holdout."""
    return F.pmod(F.xxhash64(F.lit("holdout"), doc_id), F.lit(2)) == 1


def fit(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> tuple[list[str], dict[str | None, list[tuple[str, float]]]]:
    """(languages with a stratum of their own, the steps used by stratum; the others' stratum is None)."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg((F.min("quality") == 1).alias("good"))
    labelled = stats.filter(~base_failed()).join(known, F.col("doc_id") == F.col("label_id"))
    labelled = materialize(labelled.select("doc_id", "lang", "good", held_half(F.col("doc_id")).alias("held"), *[c.alias(f"r_{r}") for r, c in ratios().items()]), "labelled")
    own = sorted(r["lang"] for r in labelled.filter("held and good and lang is not null").groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_LABELLED).collect())
    labelled = labelled.withColumn("stratum", stratum_of(own))
    # Documents that pass the same cutoffs are alike to every filter; any of their ratios stands for all.
    passed = [sum(((F.col(f"r_{r}") < c if r == "short_words" else F.col(f"r_{r}") > c).cast("int") for c in cutoffs), F.lit(0)).alias(f"c_{r}") for r, cutoffs in GRID.items()]
    design = labelled.filter("not held").groupBy("stratum", "good", *passed).agg(F.count("*").alias("n"), *[F.min(f"r_{r}").alias(f"r_{r}") for r in GRID])
    drawn: dict[str | None, list] = {}
    for r in design.select("stratum", "good", "n", *[f"r_{r}" for r in GRID]).collect():
        drawn.setdefault(r["stratum"], []).append(r)
    sequences: dict[str | None, list[tuple[str, float]]] = {}
    for stratum in [*own, None]:
        mine = drawn.get(stratum, [])
        sequences[stratum] = sequence_of(np.array([r[3:] for r in mine], float), np.array([r["good"] for r in mine], bool), risk=risk, n=np.array([r["n"] for r in mine], np.int64)) if mine else []
    # The first step that rejects a document; its filter and all stricter ones do.
    good = labelled.filter("held and good").withColumn("step", first_step(sequences, lambda rule: F.col(f"r_{rule}")))
    counts: dict[str | None, dict[int | None, int]] = {}
    for r in good.groupBy("stratum", "step").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["stratum"], {})[r["step"]] = r["n"]
    chosen = {}
    for stratum, steps in sequences.items():
        mine = counts.get(stratum, {})
        lost = [sum(mine.get(j, 0) for j in range(k + 1)) for k in range(len(steps))]
        chosen[stratum] = steps[: steps_passed(sum(mine.values()), lost, risk, delta / len(sequences))]
    return own, chosen


def first_step(sequences: dict[str | None, list[tuple[str, float]]], ratio) -> Column:
    """The number of the first step of its stratum that rejects a row of stratum ``stratum``, else null."""
    out = F.lit(None).cast("int")
    for stratum, steps in sequences.items():
        mine = F.lit(None).cast("int")
        for k, (rule, cutoff) in reversed(list(enumerate(steps))):
            mine = F.when(ratio(rule) < cutoff if rule == "short_words" else ratio(rule) > cutoff, F.lit(k)).otherwise(mine)
        if steps:
            out = F.when(F.col("stratum").eqNullSafe(F.lit(stratum)), mine).otherwise(out)
    return out


def stratum_of(own: list[str]) -> Column:
    return F.when(F.col("lang").isin(own), F.col("lang")) if own else F.lit(None).cast("string")


def report(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The base statistics, base_failed, kept, and the rule of the first step that rejected (null: none) of each row."""
    stats = materialize(statistics(docs), "stats")
    own, chosen = fit(stats, labels, risk, delta)
    # Steps by number over all strata, so that the name is one lookup.
    names = [rule for steps in chosen.values() for rule, _ in steps]
    base, at = {}, 0
    for stratum, steps in chosen.items():
        base[stratum] = at
        at += len(steps)
    step = first_step(chosen, lambda rule: ratios()[rule])
    start = F.lit(0)
    for stratum, n in base.items():
        start = F.when(F.col("stratum").eqNullSafe(F.lit(stratum)), F.lit(n)).otherwise(start)
    named = F.get(F.array(*map(F.lit, names)), start + step) if names else F.lit(None).cast("string")
    rows = stats.withColumn("stratum", stratum_of(own)).withColumn("reason", F.when(base_failed(), F.lit("base")).when(step.isNotNull(), named))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), F.col("reason").isNull().alias("kept"), F.col("reason").alias("rejected_by"))
