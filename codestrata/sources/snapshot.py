"""Snapshots: built from a tree, written beside a manifest, published by one pointer, opened with a schema check."""

from __future__ import annotations

import json
import os
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codestrata import schema
from codestrata.operators import calls as call_ops
from codestrata.operators import ownership, paths, resolution
from codestrata.functions.owners import CATCH_ALL_NAME, compile_rules
from codestrata.functions.storage import materialize, numbered
from codestrata.sources import makefiles, tree
from codestrata.sources.owners import parse_sections


POINTER = ".snapshot"


@dataclass
class Catalog:
    """Evidence tables by name, and what the manifest says."""

    tables: dict[str, DataFrame]
    manifest: dict = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(f"the snapshot has no table {name!r}") from None

    def has(self, name: str) -> bool:
        return name in self.tables


def build(spark: SparkSession, root: str, kinds: tuple[str, ...] = schema.DEFAULT_KINDS, owner_file: str = "MAINTAINERS") -> Catalog:
    """Scan, parse, own, roll up and resolve one source tree."""
    began = time.monotonic()
    raw = materialize(tree.read_tree(spark, root), "raw")
    order = [F.size(F.split("path", "/")), F.split("path", "/")]
    files = numbered(raw, "numbered_files", *order).withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("ext", F.regexp_extract("name", r"(\.[^.]+)$", 1))
    known = {r["path"] for r in raw.select("path").toLocalIterator()}  # a tree's paths, as its listing was
    texts = {r["path"]: r["content"] for r in raw.filter(F.element_at(F.split("path", "/"), -1).isin(*makefiles.NAMES, owner_file) & F.col("content").isNotNull()).select("path", "content").toLocalIterator()}
    roots: set[str] = set()
    domains = {p: d for p in known if (d := makefiles.image_domain(p))}
    flags: dict[str, dict[str, list[str]]] = {}
    for path, text in texts.items():
        if path.rpartition("/")[2] in makefiles.NAMES:
            flags[path.rpartition("/")[0]] = makefiles.include_flags(path.rpartition("/")[0], text)
            r, d = makefiles.targets(path.rpartition("/")[0], text, known)
            roots |= r
            domains |= d
    table = spark.createDataFrame(sorted(domains.items()), "path string, domain string")
    files = files.join(table, "path", "left").withColumn("call_domain", F.coalesce("domain", F.lit("kernel"))).drop("domain")
    files = materialize(files, "files")

    parsed = materialize(tree.parse_sources(raw, kinds), "parsed")
    where = files.select("path", F.col("id").alias("file_id"))
    symbols = parsed.select("path", F.posexplode("symbols").alias("at", "s")).select("path", "at", "s.*").join(where, "path").join(parsed.select("path", "warnings"), "path")
    symbols = materialize(numbered(symbols, "numbered_symbols", "file_id", "at"), "symbols")
    key = symbols.select(F.col("id").alias("owner_id"), "file_id", F.col("name").alias("o_name"), F.col("start_line").alias("o_line"), F.col("kind").alias("o_kind"))

    def attach(column: str, name: str, line: str | None, of: tuple[str, ...]) -> DataFrame:
        rows = parsed.select("path", F.inline(column)).join(where, "path")
        k = key.filter(F.col("o_kind").isin(*of)).withColumnRenamed("file_id", "o_file")
        return rows.join(k, (F.col("file_id") == F.col("o_file")) & (F.col(name) == F.col("o_name")) & (F.col(line) == F.col("o_line") if line else F.lit(True))).drop("o_file", "o_name", "o_line", "o_kind")

    members = attach("members", "owner", "owner_line", ("struct", "union")).withColumnRenamed("owner_id", "symbol_id")
    members = materialize(numbered(members, "numbered_members", "symbol_id", "ordinal"), "members")
    up = members.select(F.col("symbol_id").alias("p_symbol"), F.col("ordinal").alias("p_ordinal"), F.col("id").alias("parent_id"))
    members = members.join(up, (F.col("symbol_id") == F.col("p_symbol")) & (F.col("parent") == F.col("p_ordinal")), "left").drop("p_symbol", "p_ordinal")
    sites = attach("sites", "caller", "caller_line", ("function", "syscall")).select(F.col("owner_id").alias("caller_id"), "callee", "kind", "line", "byte_offset")
    contracts = parsed.select("path", F.inline("contracts")).join(where, "path")
    contracts = contracts.join(symbols.filter(F.col("kind").isin("function", "syscall", "prototype")).select("file_id", F.col("name").alias("n"), F.col("id").alias("symbol_id"), "start_line"), "file_id").filter("n = name and start_line > line")
    contracts = contracts.withColumn("at", F.row_number().over(Window.partitionBy("file_id", "name", "line").orderBy("start_line"))).filter("at = 1").select("symbol_id", "line", "summary", "parameters", "description", "context", "returns")
    aliases = attach("aliases", "owner", None, ("struct", "union", "enum")).select(F.col("owner_id").alias("symbol_id"), "name")

    pairs = []
    for r in parsed.select("path", F.inline("includes")).filter("name like '%.c'").toLocalIterator():
        target = makefiles.include_target(r["path"], r["name"], r["quoted"], known, flags)
        if target and target != r["path"]:
            pairs.append((r["path"], target, r["line"]))
    edges = spark.createDataFrame(pairs, "a string, b string, line int").join(where.select(F.col("path").alias("a"), F.col("file_id").alias("includer_id")), "a").join(where.select(F.col("path").alias("b"), F.col("file_id").alias("included_id")), "b").select("includer_id", "included_id", "line")
    unit_roots = spark.createDataFrame([(p,) for p in sorted(roots)], "path string").join(where, "path").select("file_id")

    sections = parse_sections(texts.get(owner_file, ""))
    dirs = materialize(paths.directories(files).join(paths.directory_counts(files), "path"), "dirs")
    directory_paths = {r["path"] for r in dirs.select("path").toLocalIterator()}
    claims = ownership.match_rules(files, compile_rules(sections, directory_paths))
    fields = [f for f in schema.TABLES["subsystems"] if f.name not in ("n_files", "n_primary_files")]
    names = spark.createDataFrame([tuple(s.get(f.name) for f in fields) for s in sections], schema.T.StructType(fields))
    claims = materialize(paths.rank_claims(claims, names), "claims")
    counts = paths.section_counts(claims, names)
    owners = paths.directory_owners(files, claims, names, CATCH_ALL_NAME).join(dirs.select("path", F.col("id").alias("dir_id")), "path")

    calls = call_ops.grouped_occurrences(sites).withColumn("callee_id", F.lit(None).cast("long"))
    outcomes = resolution.resolve(files, symbols, edges, calls, unit_roots)
    calls = resolution.apply_outcomes(calls, symbols, outcomes)
    n_symbols = symbols.groupBy("file_id").agg(F.count("*").alias("n_symbols"))
    files = files.join(dirs.select(F.col("path").alias("dir"), F.col("id").alias("dir_id")), paths.parent(F.col("path")) == F.col("dir")).join(n_symbols, F.col("id") == F.col("file_id"), "left").withColumn("n_symbols", F.coalesce("n_symbols", F.lit(0)))
    made = {
        "dirs": dirs,
        "files": files,
        "symbols": symbols.withColumn("parse_complete", F.size("warnings") == 0).withColumn("parse_warnings", F.col("warnings")).withColumn("unmatched_member_docs", F.map_from_entries("unmatched_docs")),
        "type_aliases": aliases,
        "type_members": members.withColumn("start_line", F.col("line")).withColumn("is_anonymous", F.col("name").isNull()).withColumn("generated_by", F.lit(None).cast("string")),
        "subsystems": names.join(counts.select("id", "n_files", "n_primary_files"), "id"),
        "path_subsys": claims.withColumn("ref_kind", F.lit("file")),
        "dir_subsys": owners,
        "source_includes": edges,
        "translation_unit_roots": unit_roots,
        "calls": calls,
        "call_sites": sites,
        "document_text": files.filter("path like 'Documentation/%' and content is not null").select(F.col("id").alias("file_id"), "content"),
        "function_docs": contracts,
    }
    tables = {k: df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.TABLES[k]]) for k, df in made.items()}
    version = makefiles.detect_version(texts.get("Makefile", "")) or "unknown"
    return Catalog(tables, {"schema_version": schema.SCHEMA_VERSION, "version": version, "has_calls": True, "has_call_sites": True, "has_document_text": True, "has_function_docs": True, "build_seconds": round(time.monotonic() - began, 3), "built_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())})


class Store:
    """Small files in any file system Spark can write to: the pointers and manifests of snapshots."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)
        self.local = self.fs.getScheme() == "file"

    def path(self, uri: str):
        return self.jvm.org.apache.hadoop.fs.Path(uri)

    def exists(self, uri: str) -> bool:
        return self.fs.exists(self.path(uri))

    def read(self, uri: str) -> str:
        return bytes(self.spark.read.format("binaryFile").load(uri).select("content").first()[0]).decode()

    def put(self, uri: str, text: str) -> None:
        """Writes a file beside its place and renames it there, over one that may be there, in one step."""
        new = f"{uri}.{uuid.uuid4().hex}"
        if self.local:
            target, scratch = (self.path(u).toUri().getPath() for u in (uri, new))
            with open(scratch, "w", encoding="utf-8") as f:
                f.write(text)
            os.replace(scratch, target)
            return
        out = self.fs.create(self.path(new), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        over = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(uri).toUri(), self.conf).rename(self.path(new), self.path(uri), over)

    def names(self, uri: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(uri)) if s.isFile()] if self.exists(uri) else []

    def remove(self, uri: str) -> None:
        self.fs.delete(self.path(uri), True)


def publish(catalog: Catalog, root: str, name: str | None = None, check=None) -> str:
    """Writes a snapshot's tables to a folder of their own, audits them there, then points the name at it.

    The pointer is one small file that is replaced in one step, so the name always means a whole
    snapshot, the old or the new one. A failure leaves the old one in place. check: called with
    the written Catalog, returns names of violated checks.
    """
    name = name or catalog.manifest["version"]
    spark = next(iter(catalog.tables.values())).sparkSession
    store, pointer = Store(spark, root), f"{root}/{name}{POINTER}"
    data = f"data-{name}-{uuid.uuid4().hex}"
    try:
        counts = {}
        for k, df in catalog.tables.items():
            df.write.parquet(f"{root}/{data}/{k}")
            counts[k] = spark.read.parquet(f"{root}/{data}/{k}").count()
        store.put(f"{root}/{data}/manifest.json", json.dumps(catalog.manifest | {"counts": counts}, indent=2, ensure_ascii=False))
        if check is not None and (bad := check(open_snapshot(spark, f"{root}/{data}"))):
            raise ValueError(f"the snapshot fails {sorted(bad)}")
        old = store.read(pointer) if store.exists(pointer) else None
        store.put(pointer, data)
    except BaseException:
        store.remove(f"{root}/{data}")
        raise
    if old:
        store.remove(f"{root}/{old}")
    return f"{root}/{name}"


def open_snapshot(spark: SparkSession, path: str) -> Catalog:
    """Opens and checks a snapshot, by its published path or its folder: readable version, all tables and columns; optional evidence by the manifest's flags."""
    store = Store(spark, path)
    if store.exists(path + POINTER):
        path = f"{path.rpartition('/')[0]}/{store.read(path + POINTER)}"
    manifest = json.loads(store.read(f"{path}/manifest.json"))
    if manifest.get("schema_version") not in schema.READABLE_VERSIONS:
        raise ValueError(f"schema version {manifest.get('schema_version')} can't be read")
    tables = {}
    for k, expected in schema.TABLES.items():
        if k in schema.OPTIONAL and not manifest.get(schema.OPTIONAL[k]):
            continue
        if not store.exists(f"{path}/{k}"):
            raise ValueError(f"table {k} is missing")
        found = spark.read.parquet(f"{path}/{k}")
        if missing := {f.name for f in expected} - set(found.columns):
            raise ValueError(f"table {k} lacks {sorted(missing)}")
        tables[k] = found
    return Catalog(tables, manifest)


def version_key(name: str) -> tuple:
    """Versions in their own order: numbers by value, release candidates before the release."""
    base, _, rc = name.partition("-rc")
    return (tuple(int(x) for x in re.findall(r"\d+", base)), int(rc) if rc.isdigit() else 10**9, name)


def list_snapshots(root: str, spark: SparkSession | None = None) -> list[str]:
    """The published names, in version order."""
    found = Store(spark or SparkSession.active(), root).names(root)
    return sorted((n.removesuffix(POINTER) for n in found if n.endswith(POINTER)), key=version_key)


def match_snapshot(names: list[str], prefix: str) -> str:
    """The version meant: exact, or the only one that begins so at a component's end."""
    if prefix in names:
        return prefix
    found = [n for n in names if n.startswith(prefix) and not n[len(prefix) : len(prefix) + 1].isdigit()]
    if len(found) != 1:
        raise ValueError(f"{prefix!r} matches {len(found)} snapshots")
    return found[0]


def pin(spark: SparkSession, root: str, name: str) -> None:
    """Makes a published snapshot the one that is meant when none is named."""
    Store(spark, root).put(f"{root}/pinned", match_snapshot(list_snapshots(root, spark), name))


def default_snapshot(spark: SparkSession, root: str) -> str:
    """The pinned snapshot if it is still there, else the latest."""
    names = list_snapshots(root, spark)
    store = Store(spark, root)
    pinned = store.read(f"{root}/pinned") if store.exists(f"{root}/pinned") else None
    if pinned in names:
        return pinned
    if not names:
        raise ValueError(f"no snapshot is published under {root}")
    return names[-1]
