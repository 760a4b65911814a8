"""Target resolution: ranked candidates in tiers; ambiguity is reported, never guessed away."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from codestrata.functions.text import LOWER, UPPER, ascii_fold, depth

#: Trees that hold copies, and which kinds come first.
COPY_TREES = ("tools/", "samples/", "Documentation/", "usr/")
KIND_RANK = {"function": 0, "syscall": 0, "struct": 1, "union": 1, "enum": 1, "typedef": 1, "macro": 2, "variable": 3, "prototype": 4}


#: Candidates that are listed; their number is always exact.
MOST_CANDIDATES = 1000


@dataclass
class Resolution:
    target: Row | None
    candidates: list[Row]
    note: str = ""


def normalize(spec: str) -> str:
    spec = (spec or "").strip()
    if spec in (".", "/", "./"):
        return ""
    return spec.lstrip("/").removeprefix("./").rstrip("/")


def is_copy(path: Column) -> Column:
    out = F.lit(False)
    for prefix in COPY_TREES:
        out = out | path.startswith(prefix)
    return out


def definition_order() -> list:
    """Real definitions before prototypes, the proper tree before copies, globals before statics, shallow and short paths first."""
    rank = F.lit(5)
    for kind, k in KIND_RANK.items():
        rank = F.when(F.col("symbol_kind") == kind, k).otherwise(rank)
    return [rank, is_copy(F.col("path")), F.col("is_static"), depth(F.col("path")), F.length("path"), F.col("path"), F.coalesce("line", F.lit(0)), F.col("id")]


def path_order() -> list:
    return [is_copy(F.col("path")), depth(F.col("path")), F.length("path"), F.col("path"), F.col("id")]


def _targets(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    shape = {"kind": "string", "id": "long", "path": "string", "name": "string", "symbol_kind": "string", "line": "int", "end_line": "int", "is_static": "boolean", "file_id": "long"}
    return df.select(*[columns.get(c, F.lit(kind if c == "kind" else None)).cast(t).alias(c) for c, t in shape.items()])


def symbol_targets(symbols: DataFrame, files: DataFrame) -> DataFrame:
    rows = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return _targets(rows, "symbol", id=F.col("id"), path=F.col("path"), name=F.col("name"), symbol_kind=F.col("kind"), line=F.col("start_line"), end_line=F.col("end_line"), is_static=F.col("is_static"), file_id=F.col("file_id"))


def file_targets(files: DataFrame) -> DataFrame:
    return _targets(files, "file", id=F.col("id"), path=F.col("path"), name=F.col("name"), file_id=F.col("id"))


def directory_targets(dirs: DataFrame) -> DataFrame:
    return _targets(dirs, "dir", id=F.col("id"), path=F.col("path"), name=F.col("name"))


def ranked_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Every symbol with its rank among those of its name; rank 1 is the most likely definition."""
    rows = symbol_targets(symbols, files)
    by = Window.partitionBy("name")
    return rows.withColumn("rank", F.row_number().over(by.orderBy(*definition_order()))).withColumn("candidates", F.count("*").over(by))


def resolve_symbol(symbols: DataFrame, files: DataFrame, name: str) -> Resolution:
    found = symbol_targets(symbols.filter(F.col("name") == name.strip()), files)
    rows = found.orderBy(*definition_order()).limit(MOST_CANDIDATES).collect()
    if not rows:
        return Resolution(None, [], f"no symbol in the index is named {name.strip()!r}")
    n = len(rows) if len(rows) < MOST_CANDIDATES else found.count()
    return Resolution(rows[0], rows[1:], f"{n} symbols named {name.strip()!r}; showing the most likely definition" if n > 1 else "")


def candidates(spec: str, dirs: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """All candidates of a spec with their tier (the lowest decides) and rank within it.

    0 the root; 1 path:line (innermost span first) or path:symbol; 2 directory; 3 file; 4 symbol,
    unless it is static or in a copied tree and a directory has the name; 5 file by base name;
    6 directory by name. A path:line selector never falls back to its file.
    """
    raw = normalize(spec)
    head, _, tail = raw.rpartition(":")
    d, f = directory_targets(dirs), file_targets(files)
    parts = []

    def add(tier: int, df: DataFrame, order: list):
        parts.append(df.withColumn("tier", F.lit(tier)).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(tier)).orderBy(*order))))

    if raw == "":
        add(0, d.filter("path = ''"), ["path"])
    elif head:
        here = symbol_targets(symbols, files).filter(F.col("path") == head)
        if tail.isdigit():
            add(1, here.filter(F.lit(int(tail)).between(F.col("line"), F.col("end_line"))), [F.col("end_line") - F.col("line"), *definition_order()])
        else:
            add(1, here.filter(F.col("name") == tail), definition_order())
    else:
        s = symbol_targets(symbols.filter(F.col("name") == raw), files)
        named_dirs = d.filter((F.col("name") == raw) & (F.col("path") != ""))
        weak = F.col("is_static") | is_copy(F.col("path"))
        best = s.withColumn("first", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*definition_order())) == 1)
        yields = best.filter(F.col("first") & weak).select("name").distinct().join(named_dirs.select("name").distinct(), "name", "left_semi")
        add(2, d.filter((F.col("path") == raw) & (F.col("path") != "")), path_order())
        add(3, f.filter(F.col("path") == raw), path_order())
        add(4, s.join(yields, "name", "left_anti").select(s.columns), definition_order())
        add(5, f.filter(F.col("name") == raw), path_order())
        add(6, named_dirs, path_order())
        add(7, s.join(yields, "name", "left_semi").select(s.columns), definition_order())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolve(spec: str, dirs: DataFrame, files: DataFrame, symbols: DataFrame) -> Resolution:
    found = candidates(spec, dirs, files, symbols)
    rows = found.orderBy("tier", "rank").limit(MOST_CANDIDATES).collect()
    if not rows:
        return Resolution(None, [], f"nothing in the index matches {spec!r}")
    tier = [r for r in rows if r["tier"] == rows[0]["tier"]]
    n = len(tier) if len(rows) < MOST_CANDIDATES else found.filter(F.col("tier") == rows[0]["tier"]).count()
    note = f"{n} candidates for {spec!r}; showing the most likely one" if n > 1 else ""
    return Resolution(tier[0], [*tier[1:], *[r for r in rows if r["tier"] != rows[0]["tier"]]], note)


def suggestions(spec: str, dirs: DataFrame, files: DataFrame, symbols: DataFrame, limit: int = 5, attempts: int = 4) -> DataFrame:
    """Names that hold the spec or, failing that, its shortened forms (three characters at least), nearest first."""
    raw = normalize(spec).rpartition("/")[2].translate(str.maketrans(UPPER, LOWER))
    forms = [raw[: max(3, len(raw) - k * max(1, len(raw) // 4))] for k in range(attempts)]
    forms = [x for x in dict.fromkeys(forms) if len(x) >= 3]
    named = dirs.filter("path != ''").select(F.lit("dir").alias("kind"), "name", "path").unionAll(files.select(F.lit("file").alias("kind"), "name", "path")).unionAll(symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("kind", "name", "path"))
    tier = F.lit(None).cast("int")
    for k in range(len(forms) - 1, -1, -1):
        tier = F.when(ascii_fold(F.col("name")).contains(forms[k]), k).otherwise(tier)
    rows = named.withColumn("tier", tier).filter("tier is not null")
    best = rows.agg(F.min("tier").alias("best"))
    return rows.crossJoin(F.broadcast(best)).filter("tier = best").drop("best").orderBy(F.length("name"), "name", "path").limit(limit)  # one row


def selectors(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, selector): the shortest unambiguous way to name a struct or union, null if four forms all stay ambiguous."""
    rows = symbols.filter(F.col("kind").isin("struct", "union")).join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "file_id", "path", "name", "kind", "start_line", "end_line")
    count = lambda *by: F.count("*").over(Window.partitionBy(*by))
    rows = rows.withColumn("n1", count("file_id", "name")).withColumn("n2", count("file_id", "kind", "name"))
    other = rows.select("file_id", F.col("kind").alias("k2"), F.col("start_line").alias("s2"), F.col("end_line").alias("e2"))
    spans = rows.join(other, "file_id").filter("s2 <= start_line and e2 >= start_line").groupBy("id").agg(F.count("*").alias("n3"), F.count_if(F.col("k2") == F.col("kind")).alias("n4"))
    rows = rows.join(spans, "id")
    named, lined = F.concat_ws(":", "path", "name"), F.concat_ws(":", "path", F.col("start_line").cast("string"))
    typed = lambda c: F.concat_ws(" ", "kind", c)
    return rows.select("id", F.when(F.col("n1") == 1, named).when(F.col("n2") == 1, typed(named)).when(F.col("n3") == 1, lined).when(F.col("n4") == 1, typed(lined)).alias("selector"))


def resolve_area(spec: str, dirs: DataFrame, files: DataFrame, symbols: DataFrame) -> Resolution:
    """A directory if one matches, else the directory of that name under ``kernel/``, else what resolve() finds."""
    raw = normalize(spec)
    for path in (raw, f"kernel/{raw}"):
        rows = directory_targets(dirs.filter(F.col("path") == path)).limit(1).collect()
        if rows:
            return Resolution(rows[0], [])
    return resolve(spec, dirs, files, symbols)
