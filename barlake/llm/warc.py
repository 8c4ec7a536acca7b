"""WARC archives: writing with revisit records, and a reader that salvages.

Writing: each task writes one archive of its rows, one gzip member per record, to
the shared folder, under a name of its own per attempt; a manifest table that Spark
commits lists the archives of the attempts that counted.

Reading: compressed archives are cut into byte ranges that are read side by side;
an uncompressed one is a single range, as its payloads may hold whole records.  A
range owns the records that start in it.  Every record is checked (member checksum,
version line, headers, length, end of record, digests).  After a failed check the
reader searches for the next gzip member header or version line that passes its
checks, goes on there, and logs the bytes between as a quarantined gap.

Null html is an empty payload.  Payloads of ``REVISIT_BYTES`` or more that occur
several times are stored once, with the largest id (a null id is the smallest);
the others are revisits that refer to it.  Rows that repeat that id and payload are
each a response.  Empty tables give no archive and an empty result.  Other columns
are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import scratch, slices, written

VERSION = b"WARC/1.1"
#: Version lines that are read; records of both versions have the same form.
VERSIONS = (b"WARC/1.1\r\n", b"WARC/1.0\r\n")
_LEAD = b"WARC/1."
_MEMBER = b"\x1f\x8b\x08"
#: Payloads below this size are never revisits.
REVISIT_BYTES = 1000
#: Tables of shared payloads up to this many rows (60 bytes each) are broadcast;
#: larger ones join by shuffle, where Spark splits a hot digest.
BROADCAST_TARGETS = 100_000
#: Bytes of an archive that one reading task owns.
RANGE_BYTES = 16 << 20
#: Bytes asked of an archive at a time.
CHUNK = 1 << 20
#: A record that needs more bytes than this (a bound of the format read here) is not believed.
MAX_RECORD = 1 << 31


# --- records ---------------------------------------------------------------

def record_bytes(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(payload)))])
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + payload + b"\r\n\r\n"


def gzip_member(raw: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    payload: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


class Broken(ValueError):
    """A check failed."""


_ALGORITHMS = {"sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256, "md5": hashlib.md5}


def digest_holds(labelled: str, block: bytes) -> bool:
    """False if a digest ``algorithm:value`` of the block is wrong; the value may be hex
    or base32 in any case.  One of an unknown algorithm or form is not a failed check."""
    name, _, value = labelled.partition(":")
    algorithm = _ALGORITHMS.get(name.strip().lower())
    if algorithm is None:
        return True
    digest, value = algorithm(block).digest(), value.strip().lower()
    if len(value) == 2 * len(digest):
        return value == digest.hex()
    base32 = base64.b32encode(digest).decode().rstrip("=").lower()
    return value.rstrip("=") == base32 if len(value.rstrip("=")) == len(base32) else True


def parse_record(raw: bytes) -> tuple[Record, int]:
    """The record at the start of ``raw`` and the bytes it takes."""
    if not raw.startswith(VERSIONS):
        raise Broken("version line")
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise Broken("headers")
    headers = {}
    for line in raw[len(VERSIONS[0]):end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise Broken("content length")
    start = end + 4
    stop = start + int(size)
    if raw[stop:stop + 4] != b"\r\n\r\n":
        raise Broken("end of record")
    payload = raw[start:stop]
    if not digest_holds(headers.get("warc-block-digest", ""), payload):
        raise Broken("digest")
    return Record(0, stop + 4, headers, payload), stop + 4


class View:
    """A sliding view of a seekable file: bytes by absolute offset, in chunks."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def at(self, offset: int, length: int) -> bytes:
        """``length`` bytes at ``offset``, fewer only at the end of the file."""
        stop = min(self.size, offset + length)
        if offset < self.base or offset > self.base + len(self.data):
            self.base, self.data = offset, b""
        if stop > self.base + len(self.data):
            kept = self.data[offset - self.base:]
            self.file.seek(offset + len(kept))
            more = self.file.read(max(CHUNK, stop - offset - len(kept)))
            self.base, self.data = offset, kept + more
        return self.data[offset - self.base:stop - self.base]


def _read_member(view: View, offset: int) -> Record:
    """The record in the gzip member at ``offset``, with its checksum checked."""
    z = zlib.decompressobj(31)
    out, at = [], offset
    held = 0
    while not z.eof:
        part = view.at(at, CHUNK)
        if not part:
            raise Broken("member ends early")
        try:
            got = z.decompress(part)
        except zlib.error as e:
            raise Broken(f"member: {str(e)[:60]}") from None
        if not out and got and not any(got.startswith(v[:len(got)]) for v in VERSIONS):
            raise Broken("version line")
        out.append(got)
        held += len(got)
        if held > MAX_RECORD:
            raise Broken("record too long")
        at += len(part)
    length = at - len(z.unused_data) - offset
    record, used = parse_record(b"".join(out))
    if used != held:
        raise Broken("bytes after the record")
    record.offset, record.length = offset, length
    return record


def _read_plain(view: View, offset: int) -> Record:
    """The uncompressed record whose version line is at ``offset``."""
    need = 1 << 13
    while True:
        raw = view.at(offset, need)
        try:
            record, _ = parse_record(raw)
            record.offset = offset
            return record
        except Broken:
            if len(raw) < need or need > MAX_RECORD:
                raise
            head = raw.find(b"\r\n\r\n")
            size = next((int(line[15:]) for line in raw[:max(head, 0)].lower().split(b"\r\n")
                         if line.startswith(b"content-length:") and line[15:].strip().isdigit()), None)
            if head >= 0 and (size is None or head + size + 8 <= need):
                raise
            need = head + size + 8 if head >= 0 else need * 2


def _read_at(view: View, offset: int, packed: bool = False) -> Record:
    """The record at ``offset``.  In a file of gzip members a bare record can only be
    seen through a damaged member (a stored block), so its digest must vouch for it."""
    lead = view.at(offset, len(VERSIONS[0]))
    if lead.startswith(_MEMBER):
        return _read_member(view, offset)
    if lead.startswith(_LEAD):
        record = _read_plain(view, offset)
        if packed and "warc-block-digest" not in record.headers:
            raise Broken("bare record without digest")
        return record
    raise Broken("no record starts here")


def _next_start(view: View, offset: int, stop: int) -> int:
    """The first offset in [offset, stop) where a member or version line may start."""
    at = offset
    while at < stop:
        part = view.at(at, min(CHUNK, stop - at) + len(_LEAD) - 1)
        hits = [h for h in (part.find(_MEMBER), part.find(_LEAD)) if h >= 0]
        if hits and at + min(hits) < stop:
            return at + min(hits)
        at += min(CHUNK, stop - at)
    return stop


def salvage(file, size: int, start: int = 0, stop: int | None = None) -> Iterator[Record | Gap]:
    """Records that start in [start, stop) of a file of ``size`` bytes, and the gaps
    between them.  A gap belongs to the range that owns the record before it, or to
    the range that begins the file; that range reads on past its end to the next
    good record.  Any other range begins at its first record that passes all checks."""
    view = View(file, size)
    stop = size if stop is None else min(stop, size)
    at, bad, reason = start, None, ""
    packed = view.at(0, 3) == _MEMBER
    owns = start == 0
    while at < stop:
        try:
            record = _read_at(view, at, packed)
        except Broken as e:
            if bad is None:
                bad, reason = at, str(e)
            at = _next_start(view, at + 1, stop)
            continue
        if bad is not None and owns:
            yield Gap(bad, at - bad, reason)
        bad, owns = None, True
        yield record
        at += record.length
    if not owns:
        return
    while at < size:
        try:
            _read_at(view, at, packed)
            break
        except Broken as e:
            if bad is None:
                bad, reason = at, str(e)
            at = _next_start(view, at + 1, size)
    if bad is not None:
        yield Gap(bad, at - bad, reason)


# --- archives on Spark -------------------------------------------------------

def _open_fs(path: str):
    from pyarrow import fs
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def revisit_targets(pages: DataFrame) -> DataFrame:
    """(digest, target): payloads of enough bytes that several rows share, with the
    largest page id among them."""
    return pages.filter(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(
        F.max("page_id").alias("target"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "target")


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the rows as WARC archives below ``folder``; returns the manifest
    (path, bytes, records) of the archives."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")) \
        .withColumn("digest", F.sha1("payload")).withColumn("n", F.length("payload"))
    targets = written(revisit_targets(rows.select("page_id", "digest", "n")), "targets")
    small = targets.count() <= BROADCAST_TARGETS
    joined = rows.join(targets.hint("broadcast" if small else "shuffle_hash"), "digest", "left")
    leads = joined.withColumn("lead", F.col("target").isNull() | F.col("page_id").eqNullSafe(F.col("target")))
    spark = df.sparkSession
    named = [F.col(c).cast("string").alias(c) for c in ("page_id", "target")]
    made = leads.select(named[0], "url", "payload", "digest", named[1], "lead").mapInArrow(
        _writer(folder), "path string, bytes long, records long")
    manifest = scratch(spark, "manifest")
    made.write.parquet(manifest)
    return spark.read.parquet(manifest)


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open_fs(folder)
        name = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
        out, size, records = None, 0, 0
        for batch in slices(batches, "payload"):
            if out is None:
                system.create_dir(base, recursive=True)
                out = system.open_output_stream(f"{base.rstrip('/')}/{name.rsplit('/', 1)[1]}", compression=None)
            for page, url, payload, digest, target, lead in zip(*(c.to_pylist() for c in batch.columns)):
                headers = [("WARC-Type", "response" if lead else "revisit"), ("WARC-Record-ID", _urn(page)),
                           ("WARC-Target-URI", " ".join((url or "").split())), ("Content-Type", "text/html"),
                           ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
                if not lead:
                    headers += [("WARC-Refers-To", _urn(target)),
                                ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                block = payload if lead else b""
                headers.append(("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"))
                member = gzip_member(record_bytes(headers, block))
                out.write(member)
                size += len(member)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([size], pa.int64()), pa.array([records], pa.int64())],
                names=["path", "bytes", "records"])

    return write


READ_SCHEMA = ("kind string, path string, offset long, length long, record_type string, page_id string, url string, "
               "payload_bytes long, payload_digest string, refers_to string, payload binary, reason string")


def read_archives(manifest: DataFrame, payloads: bool = True, range_bytes: int = RANGE_BYTES, id_type: str = "long") -> DataFrame:
    """Records (kind ``record``) and quarantined gaps (kind ``gap``) of the archives
    that ``manifest`` lists by path and bytes.  Page ids are read as ``id_type``; records
    of other writers have none."""
    step = F.when(F.col("path").endswith(".gz"), F.lit(range_bytes).cast("long")).otherwise(F.col("bytes"))
    ranges = manifest.filter("bytes > 0").withColumn("step", step).select("path", "bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("bytes") - 1, F.col("step"))).alias("start"), "step")
    parts = max(2 * manifest.sparkSession.sparkContext.defaultParallelism, 1)
    spread = ranges.repartition(parts, "path", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]])
                            for n, c in zip(names, READ_SCHEMA.split(", "))])
        for batch in batches:
            for path, size, start, step in zip(*(c.to_pylist() for c in batch.columns)):
                system, plain = _open_fs(path)
                rows, held = [], 0
                with system.open_input_file(plain) as file:
                    for item in salvage(file, size, start, start + step):
                        rows.append(_row(path, item, payloads))
                        held += len(rows[-1][10] or b"") + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    found = spread.mapInArrow(read, READ_SCHEMA)
    return found.withColumns({c: F.col(c).try_cast(id_type) for c in ("page_id", "refers_to")})


_URN = "<urn:page:"


def _urn(page: str | None) -> str:
    """The record id of a page id's text (null: a tail that no quoted text has)."""
    return f"{_URN}{'null:' if page is None else quote(page, safe='')}>"


def _page(value: str) -> str | None:
    tail = value.strip().removeprefix(_URN).removesuffix(">") if value.strip().startswith(_URN) else "null:"
    return None if tail == "null:" else unquote(tail)


def _row(path: str, item: Record | Gap, payloads: bool) -> tuple:
    if isinstance(item, Gap):
        return ("gap", path, item.offset, item.length, None, None, None, None, None, None, None, item.reason)
    h = item.headers
    kind = h.get("warc-type")
    stated = h.get("x-payload-length", "0")
    full = len(item.payload) if kind != "revisit" else int(stated) if stated.isdigit() else 0
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    return ("record", path, item.offset, item.length, kind, _page(h.get("warc-record-id", "")), h.get("warc-target-uri"),
            full, digest, _page(h.get("warc-refers-to", "")) if kind == "revisit" else None,
            item.payload if payloads and kind == "response" else None, None)


def round_trip(df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the pages as archives, read them back: one row per page."""
    folder = scratch(df.sparkSession, "warc")
    kind = df.select(id_col).schema[0].dataType.simpleString()
    records = read_archives(write_archives(df, folder, id_col, url, html), payloads=False, id_type=kind)
    return records.filter("kind = 'record'").select(
        F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
