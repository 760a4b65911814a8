"""Listings: canonical entries of directories, files and symbols, scopes, filters, orders and name search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.text import UPPER, LOWER, ascii_fold, checked_regex, glob_regex
from codestrata.operators.paths import ancestors, parent, under
from codestrata.schema import DEFAULT_KINDS, ENTRY, SYMBOL_KINDS

KIND_ALIASES = {
    "all": ("dir", "file", *DEFAULT_KINDS),
    "symbols": DEFAULT_KINDS,
    "paths": ("dir", "file"),
    "functions": ("function", "syscall"),
    "types": ("struct", "union", "enum", "typedef"),
}
SORTS = ("name", "path", "kind", "line", "size", "lines")
COLUMNS = ("kind", "name", "path", "line", "end_line", "span", "signature", "static", "inline", "exported", "size", "lines", "files", "subsystem", "flags", "location")


def kinds_of(words: list[str]) -> list[str]:
    """Kind words with aliases and plurals, in order, each once; an unknown word is an error."""
    out: list[str] = []
    for word in words:
        found = KIND_ALIASES.get(word) or next(((k,) for k in ("dir", "file", *SYMBOL_KINDS) if word in (k, k + "s", k + "es")), None)
        if found is None:
            raise ValueError(f"unknown kind {word!r}")
        out += [k for k in found if k not in out]
    return out


def _entry(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRY])


def directory_entries(dirs: DataFrame) -> DataFrame:
    """The hidden root is no entry, and takes no place under a limit."""
    return _entry(dirs.filter("path != ''"), kind=F.lit("dir"), name=F.col("name"), path=F.col("path"), n_files=F.col("n_files_recursive"), ref_id=F.col("id"))


def file_entries(files: DataFrame) -> DataFrame:
    return _entry(files, kind=F.lit("file"), name=F.col("name"), path=F.col("path"), size=F.col("size"), lines=F.col("lines"), ref_id=F.col("id"))


def symbol_entries(symbols: DataFrame, files: DataFrame) -> DataFrame:
    rows = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    has = set(symbols.columns)
    opt = {c: F.col(c) for c in ("signature", "is_inline") if c in has}
    return _entry(rows, kind=F.col("kind"), name=F.col("name"), path=F.col("path"), line=F.col("start_line"), end_line=F.col("end_line"), span=F.col("end_line") - F.col("start_line") + 1, is_static=F.col("is_static"), is_exported=F.col("is_exported"), ref_id=F.col("id"), **opt)


@dataclass(frozen=True)
class Scope:
    """What a level means for a target: one predicate on entry paths per stream; None leaves the stream out.
    ``within``: the paths of directories and files (kind, path) that entries must have, if given."""

    label: str
    dirs: Column | None
    files: Column | None
    symbols: Column | None
    within: DataFrame | None = None


def section_scope(name: str, subsystem_id: int, dirs: DataFrame, files: DataFrame, claims: DataFrame) -> Scope:
    """All that one section claims: files, their symbols, and the directories that hold any of its files."""
    mine = files.join(claims.filter(F.col("subsystem_id") == subsystem_id).select(F.col("ref_id").alias("id")), "id", "left_semi").select("path")
    above = mine.select(F.explode(ancestors(F.col("path"))).alias("path")).join(dirs.select("path"), "path", "left_semi").distinct()
    yes = F.lit(True)
    return Scope(f"subsystem {name}", yes, yes, yes, above.select(F.lit("dir").alias("of"), F.col("path").alias("at")).union(mine.select(F.lit("file"), "path")))


def owner_scope(path: str, kind: str, dirs: DataFrame, files: DataFrame, claims: DataFrame, sections: DataFrame, catch_all: str) -> Scope:
    """The subsystem level of a target: its only primary owner's section_scope. A plurality is no ownership:
    with several primary owners, none, or the catch-all there are no entries, and the label says why."""
    below = files.filter(under(F.col("path"), path) if kind == "dir" else F.col("path") == path).select(F.col("id").alias("ref_id"))
    owners = below.join(claims.filter("is_primary"), "ref_id", "left").groupBy("ref_id").agg(F.count("subsystem_id").alias("n"), F.min("subsystem_id").alias("s"))
    row = owners.agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.countDistinct("s").alias("kinds"), F.min("s").alias("s")).first()
    name = None
    if row["lo"] == row["hi"] == row["kinds"] == 1:
        name = sections.filter(F.col("id") == row["s"]).first()["name"]
    if name is not None and name != catch_all:
        return section_scope(name, row["s"], dirs, files, claims)
    mixed = (row["hi"] or 0) > 1 or row["kinds"] > 1
    label = "no subsystem found" if not mixed else "directory has mixed subsystem ownership" if kind == "dir" else "file has co-primary subsystem ownership"
    return Scope(label, None, None, None)


def build_scope(path: str, kind: str, level: str = "auto") -> Scope:
    """The peers of a target. auto: a directory's siblings, a file's directory, a symbol's file. The
    subsystem level needs ownership: owner_scope()."""
    level = {"dir": "dir", "file": "dir"}.get(kind, "file") if level == "auto" else level
    here = path if kind == "dir" else path.rpartition("/")[0]
    p = F.col("path")
    if level == "tree":
        return Scope("whole tree", F.lit(True), F.lit(True), F.lit(True))
    if level == "file":
        return Scope(path, None, None, p == path)
    if level == "subtree":
        return Scope(f"{here or '.'}/", under(p, here), under(p, here), under(p, here))
    if level == "dir":
        top = here if kind != "dir" else path.rpartition("/")[0]
        return Scope(top or ".", parent(p) == top, parent(p) == top, parent(p) == top)
    raise ValueError(f"unknown level {level!r}" if level != "subsystem" else "the subsystem level is owner_scope()")


def order_of(sort: str = "name") -> list:
    """Deterministic orders: sizes and lengths descend, everything else ascends."""
    if sort not in SORTS:
        raise ValueError(f"unknown sort {sort!r}")
    rank = F.when(F.col("kind") == "dir", 0).when(F.col("kind") == "file", 1).otherwise(2)
    folded, line = ascii_fold(F.col("name")), F.col("line").asc_nulls_first()
    many = F.when(F.col("kind") == "dir", F.col("n_files"))
    # The documented orders.
    key = {
        "name": [folded, "path", line, "kind"],
        "path": ["path", line, "kind", folded],
        "kind": ["kind", folded, "path", line],
        "line": ["path", line, "kind", folded],
        "size": [F.coalesce(many, F.col("size")).desc_nulls_last(), folded, "path", line, "kind"],
        "lines": [F.coalesce(many, F.col("lines"), F.col("span")).desc_nulls_last(), folded, "path", line, "kind"],
    }[sort]
    return [rank, *key, "ref_id"]


def narrowed(entries: DataFrame, kinds=(), grep: str | None = None, exported_only: bool = False, static: str = "any") -> DataFrame:
    """Kind, name and linkage filters; all come before any limit. Linkage asks for symbols only."""
    if kinds:
        entries = entries.filter(F.col("kind").isin(*kinds))
    if grep:
        entries = entries.filter(F.col("name").rlike(checked_regex(grep)))
    if exported_only:
        entries = entries.filter("is_exported")
    if static not in ("any", "only", "exclude"):
        raise ValueError(f"unknown static mode {static!r}")
    if static != "any":
        entries = entries.filter(F.col("is_static") == (static == "only"))
    return entries


def limited(df: DataFrame, limit: int) -> DataFrame:
    """0 means no limit."""
    return df.limit(limit) if limit > 0 else df


def collect(scope: Scope, dirs: DataFrame, files: DataFrame, symbols: DataFrame, kinds=(), limit: int = 0, grep: str | None = None, exported_only: bool = False, static: str = "any", sort: str = "name") -> DataFrame:
    """The entries of a scope: three streams, filtered each before they meet, then one order and limit."""
    kinds = tuple(kinds) or ("dir", "file", *DEFAULT_KINDS)
    if sort == "size" and not {"dir", "file"} & set(kinds):
        raise ValueError("symbols have no size; sort them by lines")
    streams = []
    for pred, entries, own in ((scope.dirs, lambda: directory_entries(dirs), ("dir",)), (scope.files, lambda: file_entries(files), ("file",)), (scope.symbols, lambda: symbol_entries(symbols, files), SYMBOL_KINDS)):
        if pred is not None and set(own) & set(kinds):
            rows = entries().filter(pred)
            if scope.within is not None:
                rows = rows.join(scope.within.filter(F.col("of") == ("dir" if own == ("dir",) else "file")), F.col("path") == F.col("at"), "left_semi")
            streams.append(narrowed(rows, [k for k in kinds if k in own], grep, exported_only, static))
    if not streams:
        return dirs.sparkSession.createDataFrame([], ENTRY)
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return limited(out.orderBy(*order_of(sort)), limit)


def siblings(entries: DataFrame, kind: str, ref_id: int, limit: int = 0, include_self: bool = False, sort: str = "name") -> DataFrame:
    """A scope's entries without (or with) the target; the limit counts the others."""
    own = (F.col("kind") == kind) & (F.col("ref_id") == ref_id)
    others = limited(entries.filter(~own).orderBy(*order_of(sort)), limit)
    return others.unionByName(entries.filter(own)).orderBy(*order_of(sort)) if include_self else others


def children(directory: str, dirs: DataFrame, files: DataFrame, sort: str = "name") -> DataFrame:
    """Direct subdirectories and files."""
    return directory_entries(dirs).unionByName(file_entries(files)).filter(parent(F.col("path")) == directory).orderBy(*order_of(sort))


def tree(dirs: DataFrame, directory: str, levels: int) -> DataFrame:
    """Directories below one, to a depth."""
    base = 0 if directory == "" else directory.count("/") + 1
    d = F.size(F.split("path", "/"))
    return dirs.filter((F.col("path") != "") & under(F.col("path"), directory) & (d <= base + levels)).select("path", "name", d.alias("depth"), "n_files_recursive").orderBy("path")


def search(symbols: DataFrame, files: DataFrame, pattern: str, mode: str = "substring", kinds=(), limit: int = 50, grep: str | None = None, exported_only: bool = False, static: str = "any", sort: str | None = None) -> DataFrame:
    """Symbols by name: substring and prefix ignore ASCII case, exact and glob don't. Shorter names first."""
    name, folded = F.col("name"), pattern.translate(str.maketrans(UPPER, LOWER))
    test = {
        "exact": lambda: name == pattern,
        "glob": lambda: name.rlike(glob_regex(pattern)),
        "prefix": lambda: ascii_fold(name).startswith(folded),
        "substring": lambda: ascii_fold(name).contains(folded),
    }
    if mode not in test:
        raise ValueError(f"unknown mode {mode!r}")
    if sort == "size":
        raise ValueError("symbols have no size; sort them by lines")
    rows = narrowed(symbol_entries(symbols.filter(test[mode]()), files), tuple(kinds) or SYMBOL_KINDS, grep, exported_only, static)
    order = order_of(sort)[1:] if sort else [F.length("name"), "name", "path", "line", "ref_id"]
    return limited(rows.orderBy(*order), limit)


def at_line(symbols: DataFrame, path_id: int, line: int) -> DataFrame:
    """Symbols of a file whose span holds a line, innermost first."""
    rows = symbols.filter((F.col("file_id") == path_id) & F.lit(line).between(F.col("start_line"), F.col("end_line")))
    return rows.orderBy(F.col("end_line") - F.col("start_line"), F.desc("start_line"), "id")


def kind_counts(symbols: DataFrame, file_id: int | None = None) -> DataFrame:
    rows = symbols if file_id is None else symbols.filter(F.col("file_id") == file_id)
    return rows.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def projected(entries: DataFrame, columns: list[str]) -> DataFrame:
    """A choice of the closed column vocabulary."""
    if unknown := [c for c in columns if c not in COLUMNS]:
        raise ValueError(f"unknown columns {unknown}")
    flags = F.concat_ws(" ", F.when(F.col("is_exported"), "EXPORT"), F.when(F.col("is_static"), "static"), F.when(F.col("is_inline"), "inline"))
    flags = F.coalesce(F.nullif(flags, F.lit("")), F.lit("-"))
    own = {"static": F.col("is_static"), "inline": F.col("is_inline"), "exported": F.col("is_exported"), "files": F.col("n_files"), "flags": flags, "location": F.concat_ws(":", "path", F.col("line").cast("string"))}
    return entries.select(*[own.get(c, F.col(c)).alias(c) for c in columns])


def top_per(entries: DataFrame, by: str, n: int, sort: str = "name") -> DataFrame:
    """The first n entries of each group in listing order."""
    return entries.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy(*order_of(sort)))).filter(F.col("at") <= n)
