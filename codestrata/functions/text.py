"""String rules that Spark has no function for, as column expressions or driver-side pattern compilers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column) -> Column:
    """A-Z lower-cased and nothing else: name comparison never folds other letters."""
    return F.translate(c, UPPER, LOWER)


def glob_regex(pattern: str) -> str:
    """An anchored regex for a case-sensitive glob: ``*`` and ``?`` cross ``/``; ``[..]`` and ``[^..]`` are classes."""
    out, at = [], 0
    while at < len(pattern):
        ch = pattern[at]
        end = pattern.find("]", at + 2 if pattern[at + 1 : at + 2] in ("^", "]") else at + 1) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and end > 0:
            body = pattern[at + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{body}]")
            at = end
        else:
            out.append(re.escape(ch))
        at += 1
    return "(?s)^" + "".join(out) + "$"


def literal_regex(text: str) -> str:
    """A case-insensitive regex for a literal, other alphabets included."""
    return "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", text)


def mention_regex(name: str) -> str:
    """A regex for an identifier that isn't part of a longer one."""
    return rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])"


def checked_regex(pattern: str) -> str:
    """A user's name filter as a Spark pattern: case-insensitive, searched anywhere. Invalid: ValueError."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"invalid pattern {pattern!r}: {e}") from e
    return f"(?iu){pattern}"


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.nullif(whole, F.lit(0)))


def squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def depth(path: Column) -> Column:
    """Number of slashes."""
    return F.size(F.split(path, "/")) - 1


def human_size(n: Column) -> Column:
    """Bytes as 512B, 1.5K, 2.0M or 3.0G; ``-`` if unknown."""
    out = F.concat(n.cast("string"), F.lit("B"))
    for k, unit in enumerate("KMG", 1):
        out = F.when(n >= 1024**k, F.format_string("%.1f" + unit, n / 1024**k)).otherwise(out)
    return F.coalesce(out, F.lit("-"))


def occurrences(direct: Column, indirect: Column, macro: Column) -> Column:
    """Counts as ``2d 1i``; zero counts are left out."""
    part = [F.when(c > 0, F.concat(c.cast("string"), F.lit(s))) for c, s in ((direct, "d"), (indirect, "i"), (macro, "m"))]
    return F.concat_ws(" ", *part)


#: Words that say nothing about a document's subject.
STOP_WORDS = ("api", "core", "doc", "docs", "driver", "drivers", "file", "files", "kernel", "linux", "main", "subsystem", "system")


def subject_terms(c: Column) -> Column:
    """Distinct lower-case terms of a path or name, less its extension: three characters or more, no stop words."""
    stem = F.regexp_replace(c, r"\.[^./]+$", "")
    words = F.regexp_extract_all(F.lower(stem), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def _alike(a: Column, b: Column) -> Column:
    """Equal terms score 30 and their length (12 at most); terms that begin alike in 4 or more characters 5 and that length."""
    common = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda n, k: F.when((F.length(a) >= k) & (F.length(b) >= k) & (F.substring(a, 1, k) == F.substring(b, 1, k)), k).otherwise(n))
    return F.when(a == b, 30 + F.least(F.length(a), F.lit(12))).when(common >= 4, 5 + common).otherwise(0)


def lexical_score(terms: Column, candidate: Column) -> Column:
    """Sum over terms of each one's best match among the candidate's terms."""
    return F.aggregate(terms, F.lit(0), lambda total, a: total + F.coalesce(F.array_max(F.transform(candidate, lambda b: _alike(a, b))), F.lit(0)))
