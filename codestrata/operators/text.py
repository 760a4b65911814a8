"""Text: literal search and identifier mentions over documents and contracts, headings, snippets, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.functions.text import literal_regex, mention_regex

SNIPPET, BEFORE, MOST_HITS, MOST_TEXT = 240, 70, 5000, 1024


def lines_of(documents: DataFrame, content: str = "content") -> DataFrame:
    """A row per line: the document's other columns, line (from 1) and text."""
    keep = [c for c in documents.columns if c != content]
    return documents.select(*keep, F.posexplode(F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n")).alias("at", "text")).select(*keep, (F.col("at") + 1).alias("line"), "text")


#: Characters that underline a title.
ADORNMENT = "=-~^\"'`:+#*"


def _hash_title(line: Column) -> Column:
    """The title of a Markdown heading: one to six # after at most three spaces, then white space; a closing run of # goes. Else null."""
    flush = F.ltrim(line)
    marks = F.length(flush) - F.length(F.ltrim(flush, F.lit("#")))
    rest = F.substring(flush, marks + 1, F.length(flush))
    title = F.rtrim(rest, F.lit(" \t"))
    bare = F.rtrim(title, F.lit("#"))
    title = F.trim(F.when(bare.endswith(" ") | bare.endswith("\t"), bare).otherwise(title))
    opens = marks.between(1, 6) & (rest.startswith(" ") | rest.startswith("\t")) & (F.length(line) - F.length(flush) <= 3)
    return F.when(opens & (title != ""), title)


def _is_underline(line: Column) -> Column:
    """Three or more of one adornment character and nothing else."""
    n, first = F.length(line), F.substring(line, 1, 1)
    return (n >= 3) & (F.instr(F.lit(ADORNMENT), first) > 0) & (line == F.repeat(first, n))


def headings(lines: DataFrame, key: str = "path") -> DataFrame:
    """Lines with ``heading``: the nearest Markdown or underlined heading at or above each line."""
    order = Window.partitionBy(key).orderBy("line")
    below, title = F.trim(F.lead("text").over(order)), F.trim("text")
    underlined = (title != "") & _is_underline(below) & (F.length(below) >= F.length(title))
    marked = lines.withColumn("own", F.when(underlined, title).otherwise(_hash_title(F.col("text"))))
    return marked.withColumn("heading", F.last("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("own")


def snippet(text: Column, start: Column, length: int = 0) -> Column:
    """About 240 characters of a line around a match of ``length`` that starts at ``start`` (from 0), white space squeezed; … where cut."""
    left = F.greatest(F.lit(0), start - BEFORE)
    right = F.least(F.length(text), F.greatest(start + length, left + SNIPPET))
    squeezed = F.trim(F.regexp_replace(F.substring(text, left + 1, right - left), r"\s+", " "))
    more = (right < F.length(text)) | (F.length(squeezed) > SNIPPET)
    return F.concat(F.when(left > 0, F.lit("…")).otherwise(F.lit("")), F.substring(squeezed, 1, SNIPPET), F.when(more, F.lit("…")).otherwise(F.lit("")))


def _hits(documents: DataFrame, regex: str, length: int) -> DataFrame:
    """First match of each line, late: only documents that match at all are split into lines."""
    lines = headings(lines_of(documents.filter(F.col("content").rlike(regex)).select("path", "content")))
    start = F.regexp_instr("text", F.lit(regex)) - 1
    return lines.withColumn("start", start).filter("start >= 0").select("path", "line", F.lit("documentation").alias("source_kind"), "heading", snippet(F.col("text"), F.col("start"), length).alias("snippet"))


def documentation_prefix(value: str) -> str:
    """The directory a documentation scope means; anything but a relative path of plain names is an error."""
    parts = value.strip().rstrip("/").split("/")
    if any(x in ("", ".", "..") or "\\" in x or ":" in x for x in parts):
        raise ValueError(f"{value!r} is no path below Documentation")
    return "/".join(parts if parts[0] == "Documentation" else ["Documentation", *parts])


def in_documentation(value: str) -> Column:
    """The scope as a condition on document paths: the document of that path, or what is below the directory."""
    path = documentation_prefix(value)
    return (F.col("path") == path) | F.col("path").startswith(path + "/")


def contract_texts(contracts: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(path, line, section, text) of every contract section."""
    where = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("id").alias("symbol_id"), "path")
    rows = contracts.join(where, "symbol_id")
    single = F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("text")) for s in ("summary", "description", "context", "returns")])
    params = F.transform(F.coalesce("parameters", F.array().cast("array<struct<name:string,text:string>>")), lambda p: F.struct(F.concat(F.lit("parameter "), p["name"]).alias("section"), p["text"].alias("text")))
    return rows.select("path", "line", F.inline(F.concat(single, params))).filter("coalesce(text, '') != ''")


def search(documents: DataFrame, text: str, scope: Column | None = None, mention: bool = False, contracts: DataFrame | None = None, limit: int | None = 0) -> DataFrame:
    """Literal hits (case-insensitive) or mentions of an identifier, one a line; documents come before contracts, the limit is shared.
    0 stands for ``MOST_HITS``, which no number exceeds; None gives all hits."""
    if not text.strip() or len(text) > MOST_TEXT:
        raise ValueError(f"search text must have 1 to {MOST_TEXT} characters")
    if mention and not text.isascii() or mention and not text.isidentifier():
        raise ValueError(f"{text!r} is no C identifier")
    regex = mention_regex(text) if mention else literal_regex(text)
    docs = documents if scope is None else documents.filter(scope)
    out = _hits(docs, regex, len(text)).withColumn("tier", F.lit(0))
    if contracts is not None:
        start = F.regexp_instr("text", F.lit(regex)) - 1
        found = contracts.withColumn("start", start).filter("start >= 0").select("path", "line", F.lit("contract").alias("source_kind"), F.col("section").alias("heading"), snippet(F.col("text"), F.col("start"), len(text)).alias("snippet"), F.lit(1).alias("tier"))
        out = out.union(found)
    out = out.orderBy("tier", "path", "line", "heading").drop("tier")
    return out if limit is None else out.limit(min(limit or MOST_HITS, MOST_HITS))


def contract(contracts: DataFrame, symbols: DataFrame, symbol_id: int | None = None) -> DataFrame:
    """Contracts with explicit unknowns: an empty section is null, a symbol without contract a row of nulls."""
    rows = symbols if symbol_id is None else symbols.filter(F.col("id") == symbol_id)
    rows = rows.select(F.col("id").alias("symbol_id"), "name").join(contracts, "symbol_id", "left")
    blank = {c: F.nullif(F.col(c), F.lit("")) for c in ("summary", "description", "context", "returns")}
    return rows.withColumns(blank)


def frames(traces: DataFrame, text: str = "text") -> DataFrame:
    """(…, line, nth, frame): symbol names in a backtrace, in order. A line's tokens are words (dots included)
    and signs; a name is a token up to its first dot. By line, the first that finds any: names before
    ``+ 0x…``; a token with a clone suffix alone on its line; the first name after ``in``; the only name.
    Marks like ``<TASK>`` are no frames."""
    keep = [c for c in traces.columns if c != text]
    rows = traces.select(*keep, F.posexplode(F.split(text, "\n")).alias("at", "raw")).select(*keep, (F.col("at") + 1).alias("line"), F.trim(F.translate("raw", "\t\r", "  ")).alias("l"))
    rows = rows.withColumn("tokens", F.regexp_extract_all("l", F.lit(r"[\w.]+|[^\w.\s]"), F.lit(0))).filter(F.size("tokens") > 0)

    def base(token: Column) -> Column:
        return F.substring_index(token, ".", 1)

    def named(token: Column) -> Column:
        return base(token).rlike("^[A-Za-z_]")

    first, n = F.get("tokens", F.lit(0)), F.size("tokens")
    mark = (first == "<") & (F.element_at("tokens", -1) == ">") & (n - F.when(F.get("tokens", F.lit(1)) == "/", 1).otherwise(0) == 3)
    offsets = F.filter("tokens", lambda t, i: named(t) & F.coalesce((F.get("tokens", i + 1) == "+") & F.get("tokens", i + 2).startswith("0x"), F.lit(False)))
    after = F.filter(F.slice("tokens", F.array_position("tokens", "in").cast("int") + 1, n), named)
    names = F.filter(F.flatten(F.transform("tokens", lambda t: F.split(t, r"\."))), named)
    has_offset, has_in = F.contains("l", F.lit("+")), F.contains("l", F.lit("in"))  # cheap tests first
    found = (
        F.when(has_offset & (F.size(offsets) > 0), F.transform(offsets, base))
        .when((n == 1) & named(first) & first.rlike(r"\.\w"), F.array(base(first)))
        .when(has_in & (F.array_position("tokens", "in") > 1) & (F.size(after) > 0), F.transform(F.slice(after, 1, 1), base))
        .when(F.size(names) == 1, names)
    )
    return rows.filter(~mark).select(*keep, "line", F.posexplode(found).alias("nth", "frame"))


def area_histogram(annotated: DataFrame) -> DataFrame:
    return annotated.groupBy("area").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "area")


def first_lines(documents: DataFrame, start: int, end: int) -> DataFrame:
    """A line range of each document."""
    return lines_of(documents).filter(F.col("line").between(start, end))
