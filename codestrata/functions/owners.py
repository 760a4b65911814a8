"""Ownership patterns compiled on the driver: a few thousand rules become rows that files join by directory."""

from __future__ import annotations

import re
from dataclasses import dataclass

CATCH_ALL_NAME = "THE REST"
CATCH_ALL = ("*", "*/")
CATCH_ALL_SCORE = -1000


@dataclass(frozen=True)
class Rule:
    section: int
    kind: str  # include, exclude or name
    bucket: str  # deepest directory without a wildcard; files look their ancestors up
    regex: str
    score: int


def specificity(pattern: str) -> int:
    """How precise a glob is: its literal prefix (slashes count 20) and whatever constrains it after a wildcard."""
    pattern = pattern.strip()
    if pattern in CATCH_ALL:
        return CATCH_ALL_SCORE
    cut = min((pattern.find(c) for c in "*?[" if c in pattern), default=len(pattern))
    literal, rest = pattern[:cut], pattern[cut:]
    plain = sum(ch not in "*?[]!^/\\" for ch in rest)
    starred = sum(sum(ch not in "*?[]!^\\" for ch in part) for part in rest.split("/") if set(part) & set("*?["))
    return 20 * literal.count("/") + len(literal) + plain + starred


def name_specificity(pattern: str) -> int:
    """A name regex's precision by its longest literal run, between 30 and 80."""
    return 30 + min(50, 2 * max(map(len, re.findall(r"[A-Za-z0-9_/-]+", pattern)), default=0))


def path_regex(pattern: str) -> str | None:
    """The start-anchored regex of an ownership glob; None if it isn't one.

    Patterns that neither end in ``/`` nor hold ``**`` only match paths of their own depth.
    """
    pattern = pattern.strip()
    if not pattern:
        return None
    parts = re.findall(r"\*\*|\[[^\]]*\]|.", pattern, re.S)
    meaning = {"**": "(?:.*)", "*": ".*", "?": ".", ".": r"\.", "[": r"\["}
    body = "".join(p if len(p) > 2 and p[0] == "[" else meaning.get(p, p) for p in parts)
    same_depth = "" if pattern.endswith("/") or "**" in pattern else rf"(?=(?:[^/]*/){{{pattern.count('/')}}}[^/]*$)"
    try:
        re.compile(f"^{same_depth}{body}")
    except re.error:
        return None
    return f"^{same_depth}{body}"


def bucket(pattern: str) -> str:
    literal = re.split(r"[*?\[]", pattern.strip(), maxsplit=1)[0]
    return literal.rpartition("/")[0]


def compile_rules(sections: list[dict], directories: set[str] = frozenset()) -> list[Rule]:
    """sections: {"id", "files", "excludes", "regexes"}. A bare path that is a directory covers what is below it;
    invalid patterns are skipped."""
    out = []
    for s in sections:
        for kind, patterns in (("include", s.get("files", ())), ("exclude", s.get("excludes", ()))):
            for p in patterns:
                p = p.strip()
                full = p + "/" if p in directories else p
                regex = path_regex(full)
                if regex is not None:
                    out.append(Rule(s["id"], kind, bucket(full), regex, specificity(p)))
        for p in s.get("regexes", ()):
            try:
                re.compile(p)
            except re.error:
                continue
            out.append(Rule(s["id"], "name", "", p, name_specificity(p)))
    return out
