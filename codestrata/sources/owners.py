"""The ownership file: blocks of tagged lines to sections."""

from __future__ import annotations

import re

#: What a tag's lines are.
TAGS = {"M": "maintainers", "R": "reviewers", "L": "lists", "S": "status", "W": "websites", "Q": "patchwork", "B": "bugs", "C": "chats", "P": "profiles", "T": "trees", "F": "files", "X": "excludes", "N": "regexes", "K": "keywords"}


def parse_sections(text: str) -> list[dict]:
    """Sections in file order with ids from 0. A block without a name line (prose) is none; one without patterns is kept."""
    out = []
    for block in re.split(r"\n[ \t]*\n", text.replace("\r\n", "\n")):
        lines = [x.rstrip() for x in block.split("\n") if x.strip()]
        tagged = [(x[0], x[2:].strip()) for x in lines if re.match(r"[A-Z]:", x)]
        names = [x.strip() for x in lines if not re.match(r"[A-Z]:", x)]
        if not tagged or not names or re.match(r"[A-Z]:", lines[0]):
            continue
        first = next(i for i, x in enumerate(lines) if re.match(r"[A-Z]:", x))
        section: dict = {"id": len(out), "name": lines[first - 1].strip(), "status": ""} | {v: [] for v in TAGS.values() if v != "status"}
        for tag, value in tagged:
            if tag == "S":
                section["status"] = value
            elif tag in TAGS:
                section[TAGS[tag]].append(value)
        out.append(section)
    return out
