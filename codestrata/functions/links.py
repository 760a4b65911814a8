"""Links to upstream sources for a version, path and line."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

MAINLINE = "https://git.kernel.org/pub/scm/linux/kernel/git/torvalds/linux.git"
STABLE = "https://git.kernel.org/pub/scm/linux/kernel/git/stable/linux.git"
_RELEASE = re.compile(r"v?(\d+(?:\.\d+){1,3})(-rc\d+)?")


def _release(version: str) -> tuple[list[int], str] | None:
    """Numbers and candidate suffix of a release; None if there is no such release.

    From 3.0 on, X.Y is mainline and X.Y.Z with a positive Z stable; 2.6.Z was mainline and
    2.6.Z.N stable. Candidates are mainline.
    """
    found = _RELEASE.fullmatch(version.strip())
    if not found:
        return None
    parts, rc = [int(p) for p in found[1].split(".")], found[2] or ""
    if not rc:
        own = 3 if parts[:2] == [2, 6] else 2
        if parts[0] >= 3 or own == 3:
            if len(parts) not in (own, own + 1) or (len(parts) == own + 1 and not parts[-1]):
                return None
    return parts, rc


def release_tag(version: str) -> str | None:
    """``6.12.104`` is tag ``v6.12.104``; None if it isn't a release."""
    return f"v{version.strip().removeprefix('v')}" if _release(version) else None


def series(version: str) -> str:
    """What documentation is published under: ``v6.12``, or ``latest``."""
    found = re.match(r"v?(\d+)\.(\d+)(?:\.|$|-)", version.strip())
    return f"v{found[1]}.{found[2]}" if found else "latest"


def browser_tag(version: str) -> str:
    """The tag of a source browser; unreleased trees are ``latest``."""
    v = version.strip()
    return "latest" if not v or v.startswith("next-") else f"v{v.removeprefix('v')}"


def repository(version: str) -> str | None:
    """Stable releases are in the stable repository, others in mainline."""
    found = _release(version)
    if found is None:
        return None
    parts, rc = found
    return STABLE if not rc and len(parts) > (3 if parts[:2] == [2, 6] else 2) else MAINLINE


def has_provenance(version: str, source: str | None) -> bool:
    """Whether a snapshot may link upstream: a release whose recorded source, if any, is its own archive."""
    if _release(version) is None:
        return False
    name = f"linux-{version.strip().removeprefix('v')}.tar."
    return source in (None, "kernel.org") or re.fullmatch(r"https://(?:\w+\.)?kernel\.org/(?:.*/)?" + re.escape(name) + "(?:xz|gz|bz2)", source) is not None


def archive_url(version: str) -> str | None:
    """Where a release's archive is."""
    tag = release_tag(version)
    return f"https://cdn.kernel.org/pub/linux/kernel/v{tag[1:].split('.')[0]}.x/linux-{tag[1:]}.tar.xz" if tag else None


def source_link(version: str, path: Column, line: Column | None = None) -> Column:
    """A column of links to path at version; null if the version isn't a release."""
    tag, repo = release_tag(version), repository(version)
    if tag is None:
        return F.lit(None).cast("string")
    quoted = F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    link = F.concat(F.lit(f"{repo}/tree/"), quoted, F.lit(f"?h={tag}"))
    return link if line is None else F.concat(link, F.coalesce(F.concat(F.lit("#n"), line.cast("string")), F.lit("")))


def plain_link(version: str, path: str, line: int | None = None) -> str | None:
    tag = release_tag(version)
    if tag is None:
        return None
    return f"{repository(version)}/tree/{quote(path)}?h={tag}" + (f"#n{line}" if line else "")
