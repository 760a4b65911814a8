"""Source trees: a listing, file contents with their status, and what the scanner finds in them."""

from __future__ import annotations

import io
import json
import os
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codestrata.sources import cscan

#: Follows a tree's name: the list of its links in a store that has none.
LINKS = ".links.json"
SKIPPED = (".git", ".github", ".svn", "__pycache__")
PARSE_CAP, TEXT_CAP, PROBE = 4 << 20, 1 << 20, 8192
SOURCE_EXT, DOC_EXT = (".c", ".h", ".h_shipped", ".S"), (".rst", ".txt", ".md", ".yaml", ".yml")

FILE_COLUMNS = "path string, size long, lines long, is_symlink boolean, link_target string, index_status string, index_error string, content string"
_SYMBOL = "name:string,kind:string,start_line:int,end_line:int,signature:string,is_static:boolean,is_inline:boolean,is_exported:boolean,is_anonymous:boolean,summary:string,description:string,conditions:array<string>,unmatched_docs:array<struct<name:string,text:string>>"
_MEMBER = "owner:string,owner_line:int,ordinal:int,parent:int,depth:int,name:string,kind:string,type_text:string,declaration:string,line:int,end_line:int,bit_width:string,array_dimensions:array<string>,description:string,description_source:string,visibility:string,conditions:array<string>"
_SITE = "caller:string,caller_line:int,callee:string,kind:string,line:int,byte_offset:long"
_CONTRACT = "name:string,line:int,summary:string,parameters:array<struct<name:string,text:string>>,description:string,context:string,returns:string"
PARSED = f"path string, symbols array<struct<{_SYMBOL}>>, members array<struct<{_MEMBER}>>, sites array<struct<{_SITE}>>, contracts array<struct<{_CONTRACT}>>, includes array<struct<name:string,quoted:boolean,line:int>>, aliases array<struct<owner:string,owner_line:int,name:string>>, warnings array<string>"


def listing(root: str) -> list[tuple[str, str | None]]:
    """(path, link target) of every file in breadth-first, name-sorted order; links are recorded, not followed. Errors abort."""
    out, queue = [], [""]
    while queue:
        nxt = []
        for directory in queue:
            with os.scandir(os.path.join(root, directory)) as entries:
                for e in sorted(entries, key=lambda e: e.name):
                    path = f"{directory}/{e.name}" if directory else e.name
                    if e.is_symlink():
                        out.append((path, os.readlink(e.path)))
                    elif e.is_dir():
                        if e.name not in SKIPPED:
                            nxt.append(path)
                    elif e.is_file():
                        out.append((path, None))
        queue = nxt
    return out


def _keeps(path: str) -> int:
    """How many bytes of a file's text are kept at most; 0 if its text isn't used."""
    ext = os.path.splitext(path)[1]
    if ext in SOURCE_EXT:
        return PARSE_CAP
    if path.startswith("Documentation/") and ext in DOC_EXT:
        return TEXT_CAP
    return PARSE_CAP if path.rpartition("/")[2] in ("Makefile", "Kbuild", "Build", "MAINTAINERS") else 0


def read_counted(source, path: str, step: int = 1 << 20) -> tuple[int, int, str, str | None]:
    """(bytes, lines, status, text to keep) of an open binary file, read in steps: no more than the cap is held."""
    cap, size, newlines, binary, last, held = _keeps(path), 0, 0, False, b"", bytearray()
    while chunk := source.read(step):
        if size < PROBE:
            binary |= b"\0" in chunk[: PROBE - size]
        size, newlines, last = size + len(chunk), newlines + chunk.count(b"\n"), chunk[-1:]
        if cap and not binary and size <= cap:
            held += chunk
        else:
            held.clear()
    lines = newlines + (size > 0 and last != b"\n")
    code = os.path.splitext(path)[1] in SOURCE_EXT
    if binary:
        return size, lines, "skipped_binary" if code else "binary", None
    if code and size > cap:
        return size, lines, "skipped_oversize", None
    return size, lines, "parsed" if code else "indexed", held.decode("utf-8", "replace") if cap and size <= cap else None


def upload(spark: SparkSession, source: str, root: str) -> None:
    """A tree that the driver can open, written to any store Spark writes to. Links, which most stores
    can't hold, go to a list beside the tree, from which ``read_tree`` takes them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(conf)
    if fs.getScheme() == "file":
        shutil.copytree(source, at.toUri().getPath(), symlinks=True)
        return
    links = {}
    for path, link in listing(source):
        if link is None:
            fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(source)}", path), jvm.org.apache.hadoop.fs.Path(at, path))
        else:
            links[path] = link
    out = fs.create(jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + LINKS), True)
    try:
        out.write(bytearray(json.dumps(links).encode()))
    finally:
        out.close()


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """Files of a tree, with content where it is used: from a folder the executors can open, where reading
    is spread over tasks by path, or from any other store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getScheme() != "file":
        return read_binary_files(spark, root)
    root = at.toUri().getPath()
    listed = spark.createDataFrame(listing(root), "path string, link_target string")

    def read(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, link in zip(frame["path"], frame["link_target"]):
                if link is not None:
                    rows.append((path, 0, 0, True, link, "symlink", None, None))
                    continue
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        size, n, status, text = read_counted(f, path)
                    rows.append((path, size, n, False, None, status, None, text))
                except OSError as e:  # recorded as evidence, not hidden
                    rows.append((path, 0, 0, False, None, "read_error", str(e), None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FILE_COLUMNS.split(", ")]).astype({"link_target": object, "index_error": object, "content": object})

    parts = max(1, min(4 * spark.sparkContext.defaultParallelism, 1 + listed.count() // 250))
    return listed.repartition(parts, "path").mapInPandas(read, FILE_COLUMNS)


def read_binary_files(spark: SparkSession, root: str) -> DataFrame:
    """The same from any store Spark reads, by its binary file source; links are those that ``upload`` listed. Spark
    lists no names there that begin with a dot or an underscore."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.makeQualified(at).toString().rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = rows.select(F.substring("path", len(top) + 1, 1 << 20).alias("path"), "length", "content")
    beside = root.rstrip("/") + LINKS
    links = json.loads(bytes(spark.read.format("binaryFile").load(beside).select("content").first()[0])) if fs.exists(jvm.org.apache.hadoop.fs.Path(beside)) else {}
    linked = spark.createDataFrame([(p, 0, 0, True, to, "symlink", None, None) for p, to in sorted(links.items())], FILE_COLUMNS)

    def read(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for path, size, raw in zip(frame["path"], frame["length"], frame["content"]):
                _, n, status, text = read_counted(io.BytesIO(raw), path)
                out.append((path, size, n, False, None, status, None, text))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FILE_COLUMNS.split(", ")]).astype({"link_target": object, "index_error": object, "content": object})

    return rows.mapInPandas(read, FILE_COLUMNS).union(linked)


def parse_sources(files: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """One row per parsed file with everything found in it, nested; ``inline`` each array into its table."""
    wanted = frozenset(kinds) if kinds else None

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["content"]):
                p = cscan.parse(text, wanted)
                plain = cscan.as_rows(p)
                contracts = [{"name": c.name, "line": c.line, "summary": c.summary, "parameters": [{"name": a, "text": b} for a, b in c.parameters], "description": c.description, "context": c.context, "returns": c.returns} for c in p.contracts]
                rows.append((path, plain["symbols"], plain["members"], plain["sites"], contracts, [dict(zip(("name", "quoted", "line"), i)) for i in p.includes], [dict(zip(("owner", "owner_line", "name"), a)) for a in p.aliases], p.warnings))
            yield pd.DataFrame(rows, columns=["path", "symbols", "members", "sites", "contracts", "includes", "aliases", "warnings"])

    return files.filter("index_status = 'parsed'").select("path", "content").mapInPandas(run, PARSED)
