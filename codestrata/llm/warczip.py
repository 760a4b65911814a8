"""WARC records inside ZIP packages: written as stored members, read back by range reads.

A package is one ZIP file with the stored members ``archive/data.warc.gz`` (one gzip member a
record) and ``indexes/index.cdx`` (a JSON line a record: page, offset, length). ``ZipDirectory``
parses the end record, the ZIP64 locator and end record, the central directory with ZIP64
extra fields, and local headers, through ranged reads only: nothing is extracted and no
member is held whole. ``read_records`` fetches each record by its index range; a package
without an index is walked record by record.

Files are reached through Arrow's file systems, so a package may lie in any shared store.
Writers give every attempt its own file name; only files named in the written manifest count,
so a lost or repeated task leaves nothing that is read. A package takes records up to
``PACKAGE`` bytes of payload; packages are read by as many tasks as there are packages.

Which payloads repeat is decided on digests. A payload moves only if a bit table can't clear it
of being one of them, and not even then if its digest is among the very frequent ones.

Defined results: null html is an empty payload; payloads of at least ``MIN_BYTES`` bytes that
occur more than once have one response, at the largest page_id; a null page_id is never that
one unless all are null, and rows equal in page_id and payload are all the response; a null
url is written as an empty target; extra columns are ignored; an empty table gives an empty
result. Damaged packages raise ``BadPackage``.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.shared import apart, fresh_path, join_hot, materialize

MIN_BYTES, PACKAGE = 1000, 256 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
EOCD, EOCD64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


class BadPackage(ValueError):
    """The file isn't a readable ZIP package."""


class ZipDirectory:
    """The members of a ZIP file by name: (data offset, size), found by ranged reads of ``source``."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = self._at(max(0, size - 65557), min(size, 65557))
        end = len(tail)
        while True:
            end = tail.rfind(EOCD, 0, end)
            if end < 0:
                raise BadPackage("no end of central directory")
            if len(tail) >= end + 22 and len(tail) - end - 22 == struct.unpack_from("<H", tail, end + 20)[0]:
                break
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        place = size - len(tail) + end
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            locator = self._at(place - 20, 20) if place >= 20 else b""
            if locator[:4] != LOCATOR:
                raise BadPackage("no ZIP64 locator")
            record = self._at(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != EOCD64:
                raise BadPackage("no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        self.members = dict(self._entries(self._at(start, length), count))

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        found = self.source.read(length)
        if len(found) != length:
            raise BadPackage(f"{length} bytes at {offset} are out of reach")
        return bytes(found)

    @staticmethod
    def _entries(directory: bytes, count: int):
        at = 0
        for _ in range(count):
            if directory[at : at + 4] != CENTRAL:
                raise BadPackage("broken central directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, at + 20)
            offset = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            wide = [plain, packed, offset]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:
                    body, k = extra[4 : 4 + n], 0
                    for i, value in enumerate(wide):
                        if value == 0xFFFFFFFF:
                            wide[i] = struct.unpack_from("<Q", body, k)[0]
                            k += 8
                extra = extra[4 + n :]
            yield name, (method, wide[2], wide[1])
            at += 46 + n_name + n_extra + n_comment

    def stored(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes are: (offset, length)."""
        method, offset, size = self.members[name]
        if method:
            raise BadPackage(f"{name} is compressed; only stored members can be read by range")
        header = self._at(offset, 30)
        if header[:4] != LOCAL:
            raise BadPackage(f"no local header for {name}")
        n_name, n_extra = struct.unpack_from("<HH", header, 26)
        return offset + 30 + n_name + n_extra, size

    def read(self, name: str, offset: int, length: int) -> bytes:
        start, size = self.stored(name)
        if offset < 0 or offset + length > size:
            raise BadPackage(f"{name} ends before {offset + length}")
        return self._at(start + offset, length)

    def archives(self) -> list[str]:
        return sorted(n for n in self.members if n.startswith("archive/") and n.endswith((".warc", ".warc.gz")))

    def indexes(self) -> list[str]:
        return sorted(n for n in self.members if n.startswith("indexes/") and n.endswith((".cdx", ".cdxj")))


def warc_record(page: int | None, url: str, kind: str, payload: bytes, size: int, sha1: str, refers: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no payload, but its digest and length."""
    clean = " ".join(url.split())
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(head).encode() + payload + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise BadPackage("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise BadPackage("record is cut off")
    return fields, rest[:size]


def _file(uri: str):
    return pafs.FileSystem.from_uri(uri)


def write_package(uri: str, records) -> int:
    """records: (page, url, kind, payload, size, sha1, refers). Returns how many were written."""
    fs, path = _file(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    index: list[str] = []
    with fs.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as package:
        at = 0
        with package.open(DATA, "w", force_zip64=True) as data:
            for page, url, kind, payload, size, sha1, refers in records:
                body = gzip.compress(warc_record(page, url or "", kind, payload, size, sha1, refers), 1, mtime=0)
                data.write(body)
                index.append(json.dumps({"page": page, "offset": at, "length": len(body)}))
                at += len(body)
        package.writestr(INDEX, "\n".join(index))
    return len(index)


def _walk(zipped: ZipDirectory, name: str, step: int = 1 << 18):
    """Records of a .warc.gz member without an index, one gzip member after the other."""
    start, size = zipped.stored(name)
    at, left = 0, b""
    while at < size or left:
        plain, d = bytearray(), zlib.decompressobj(31)
        while not d.eof:
            if not left:
                if at >= size:
                    raise BadPackage("gzip member is cut off")
                left = zipped._at(start + at, min(step, size - at))
                at += len(left)
            plain += d.decompress(left)
            left = d.unused_data
        yield bytes(plain)


def read_records(uri: str):
    """(headers, block) of every record of a package, one at a time."""
    fs, path = _file(uri)
    with fs.open_input_file(path) as source:
        zipped = ZipDirectory(source)
        indexed = zipped.indexes()
        if indexed and len(zipped.archives()) == 1:
            data = zipped.archives()[0]
            base, size = zipped.stored(data)
            for name in indexed:
                start, n = zipped.stored(name)
                for line in zipped._at(start, n).decode().split("\n"):
                    if line:
                        entry = json.loads(line)
                        if entry["offset"] + entry["length"] > size:
                            raise BadPackage("index points past its archive")
                        raw = zipped._at(base + entry["offset"], entry["length"])
                        yield parse_record(gzip.decompress(raw) if data.endswith(".gz") else raw)
        else:
            for data in zipped.archives():
                yield from map(parse_record, _walk(zipped, data))


def decided(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, size, sha1, kind and refers of each row of pages."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    rows = rows.withColumn("size", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    large = F.col("size") >= min_bytes
    counts = materialize(rows.filter(large).groupBy("sha1").agg(F.count("*").alias("n"), F.max("page_id").alias("top")), "digests")
    total = counts.agg(F.sum("n")).first()[0] or 0
    repeated = materialize(counts.filter("n > 1"), "repeated")
    clear, rest = apart(rows.withColumn("key", F.when(large, F.xxhash64("sha1"))), "key", repeated.select(F.xxhash64("sha1").alias("key")))
    rest = join_hot(rest.drop("key"), repeated, ["sha1"], "n", total, "left")
    both = clear.drop("key").withColumn("top", F.lit(None).cast("long")).withColumn("n", F.lit(None).cast("long")).unionByName(rest)
    # A digest whose page_ids are all null has n, but no top: its rows are all the response.
    revisit = F.col("n").isNotNull() & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return both.select("page_id", "url", "html", "size", "sha1", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("top")).alias("refers"))


def write_packages(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, package: int = PACKAGE) -> DataFrame:
    """Writes each task's records as packages under folder; returns the written manifest (path, records)."""

    def run(batches):
        def rows():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for page, url, html, size, sha1, kind, refers in zip(*(part.column(c).to_pylist() for c in range(7))):
                        yield page, url, kind, b"" if kind == "revisit" else html.encode("utf-8"), size, sha1, refers

        def up_to(first, records):
            yield first
            held = len(first[3])
            while held < package and (record := next(records, None)) is not None:
                yield record
                held += len(record[3])

        records = rows()
        while (first := next(records, None)) is not None:
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            n = write_package(path, up_to(first, records))
            yield pa.RecordBatch.from_pydict({"path": pa.array([path], pa.string()), "records": pa.array([n], pa.int64())})

    return materialize(decided(pages, min_bytes).mapInArrow(run, "path string, records long"), "manifest")


def read_packages(manifest: DataFrame) -> DataFrame:
    """A row per record of the packages named in ``path``: page_id, url, record_type, refers_to, payload_bytes, payload_digest.

    A response's digest and length are taken from the payload read back, and must agree with its headers.
    """
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def page_of(urn: str | None) -> int | None:
        found = (urn or "").rstrip(">").rpartition(":")[2]
        return int(found) if found else None

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for fields, block in read_records(path):
                    size, digest = int(fields["warc-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response":
                        if (len(block), hashlib.sha1(block).hexdigest()) != (size, digest):
                            raise BadPackage(f"payload of {fields['warc-record-id']} differs from its digest")
                    rows.append((page_of(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], page_of(fields.get("warc-refers-to")), size, digest))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    spread = manifest.select("path").repartition(max(1, manifest.count()))  # numbered, so that small rows aren't merged into one task
    return spread.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes pages as packages in the shared folder and reads them back."""
    folder = fresh_path(pages.sparkSession, "packages")
    rows = read_packages(write_packages(pages, folder, min_bytes))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN top IS NOT NULL AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM p LEFT JOIN t ON p.payload_digest = t.payload_digest AND payload_bytes >= 1000
"""
