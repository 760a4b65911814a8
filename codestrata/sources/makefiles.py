"""Makefiles: logical assignments, the programs and objects they build, and the domains that follow."""

from __future__ import annotations

import re

NAMES = ("Makefile", "Kbuild", "Build")
_ASSIGN = re.compile(r"^([\w.$(){}+%/-]+?)\s*(\+=|:=|\?=|::=|=)\s*(.*)$")


def assignments(text: str) -> list[tuple[str, str, str]]:
    """(name, operator, value) of logical lines; recipes, comments and ``define`` bodies are none."""
    out, inside = [], False
    for raw in re.sub(r"\\\n[ \t]*", " ", text.replace("\r\n", "\n")).split("\n"):
        if inside:
            inside = not re.match(r"\s*endef\b", raw)
            continue
        if re.match(r"\s*(?:override\s+)?define\b", raw):
            inside = True
        elif not raw.startswith("\t"):
            line = re.sub(r"(?<!\\)#.*$", "", raw).strip()
            if found := _ASSIGN.match(line):
                out.append((found[1], found[2], found[3].strip()))
    return out


def detect_version(text: str) -> str | None:
    """``VERSION``.``PATCHLEVEL``.``SUBLEVEL`` and ``EXTRAVERSION`` of a top Makefile."""
    v = {name: value for name, op, value in reversed(assignments(text)) if op == "="}
    if not v.get("VERSION") or not v.get("PATCHLEVEL"):
        return None
    return f"{v['VERSION']}.{v['PATCHLEVEL']}" + (f".{v['SUBLEVEL']}" if v.get("SUBLEVEL") else "") + v.get("EXTRAVERSION", "")


def _join(directory: str, name: str) -> str:
    parts: list[str] = []
    for p in f"{directory}/{name}".split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def targets(directory: str, text: str, files: set[str]) -> tuple[set[str], dict[str, str]]:
    """(sources linked as objects of their own, domain of each source that belongs to a program).

    ``obj-*`` and ``lib-*`` link objects; composites name their parts in ``x-y``, ``x-objs`` or
    ``x-$(…)``; ``hostprogs``, ``userprogs`` and ``PROG`` are programs of the directory.
    """
    values: dict[str, list[str]] = {}
    for name, op, value in assignments(text):
        words = value.split()
        values[name] = (values.get(name, []) + words) if op == "+=" else words
    source = lambda obj: next((p for e in (".c", ".S") if (p := _join(directory, re.sub(r"\.o$", "", obj) + e)) in files), None)

    def parts(stem: str) -> list[str]:
        return [w for name, ws in values.items() if re.fullmatch(re.escape(stem) + r"-(?:y|m|objs|cobjs|\$[({]\w+[)}])", name) for w in ws if w.endswith(".o")]

    roots: set[str] = set()
    for name, words in values.items():
        if re.match(r"(?:obj|lib|core)-", name):
            for w in words:
                if w.endswith(".o"):
                    found = [p for p in map(source, parts(w[:-2]) or [w]) if p]
                    roots.update(found)
    domains: dict[str, str] = {}
    for name in ("hostprogs", "hostprogs-y", "hostprogs-always-y", "userprogs", "userprogs-always-y", "always-hostprogs", "PROG", "PROGS"):
        for program in values.get(name, []):
            stem = program.removesuffix(".c")
            own = parts(stem) or values.get("SRCS", []) if name.startswith("PROG") else parts(stem)
            for obj in own or [stem + ".o"]:
                if p := source(re.sub(r"\.c$", ".o", obj)):
                    domains[p] = f"program:{directory}:{stem}"
                    roots.add(p)
    return roots, domains


#: Kernel-side files beside a vDSO's own.
VDSO_GLUE = ("extable.c", "vma.c", "vdso.c", "vdso32-setup.c")


def image_domain(path: str) -> str | None:
    """The separately linked image a path belongs to, None for the kernel proper.

    A BPF program is an image of its own; the EFI stub is one; an architecture's boot, compressed
    boot, purgatory and real-mode directories are one each; a vDSO directory is one, less the
    kernel-side files in it (VDSO_GLUE).
    """
    if path.endswith(".bpf.c"):
        return f"isolated:{path}"
    if path.startswith("drivers/firmware/efi/libstub/"):
        return "image:efi-stub"
    if found := re.match(r"arch/([^/]+)/(boot/compressed|boot|purgatory|realmode)/", path):
        return f"image:arch:{found[1]}:{found[2].replace('/', '-')}"
    found = re.match(r"(arch/[^/]+/(?:(?!vdso|include/)[^/]+/)*vdso[^/]*)/(?:.*/)?([^/]+)$", path)
    return f"image:{found[1]}" if found and found[2] not in VDSO_GLUE else None


#: Where all of the kernel's sources look, in this order, after their architecture's own directories.
SHARED_INCLUDES = ("include", "include/uapi")


def include_flags(directory: str, text: str) -> dict[str, list[str]]:
    """The ``-I`` directories that a Makefile adds, relative to the tree: by ``""`` for its own directory's
    sources, ``"/"`` for those of all directories below too, and an object's name for that one.

    ``$(srctree)`` is the tree's root and ``$(src)``, ``$(obj)`` are the Makefile's directory; a path
    without either is meant from the root, as builds run there. Directories that hold another
    variable, and absolute ones, aren't known and are left out.
    """
    out: dict[str, list[str]] = {}
    for name, op, value in assignments(text):
        found = re.fullmatch(r"(subdir-)?(?:cc|as)flags-(?:y|m|\$[({]\w+[)}])|EXTRA_CFLAGS|[CA]FLAGS_([\w./-]+\.o)", name)
        if not found:
            continue
        key = "/" if found[1] else found[2] or ""
        if op != "+=" and key in out:
            out[key] = []
        for flag in re.findall(r"(?:^|\s)-I\s*(\S+)", value):
            path = re.sub(r"\$[({](?:src|obj)[)}]", directory or ".", re.sub(r"\$[({](?:src|obj)tree[)}]/?", "", flag))
            if "$" not in path and not path.startswith("/"):
                out.setdefault(key, []).append(_join("", path))
    return out


def include_dirs(includer: str, flags: dict[str, dict[str, list[str]]]) -> list[str]:
    """The directories where an includer's headers are looked for, in order: architecture, shared, then what
    Makefiles add, outer directories' before inner ones'. flags: include_flags() by directory."""
    directory, _, file = includer.rpartition("/")
    arch = re.match(r"arch/[^/]+", includer)
    found = [f"{arch[0]}/include", f"{arch[0]}/include/uapi"] if arch else []
    found += SHARED_INCLUDES
    parts = directory.split("/") if directory else []
    for k in range(len(parts) + 1):
        found += flags.get("/".join(parts[:k]), {}).get("/", [])
    own = flags.get(directory, {})
    found += own.get("", []) + own.get(re.sub(r"\.[cS]$", ".o", file), [])
    return list(dict.fromkeys(found))


def include_target(includer: str, name: str, quoted: bool, files: set[str], flags: dict[str, dict[str, list[str]]] | None = None) -> str | None:
    """The file an ``#include`` of a source means: beside it if quoted, else the first of include_dirs() that has it; None if unknown."""
    beside = _join(includer.rpartition("/")[0], name)
    if quoted and beside in files:
        return beside
    for root in [*include_dirs(includer, flags or {}), ""]:
        if (p := _join(root, name)) in files:
            return p
    return None
