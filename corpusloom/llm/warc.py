"""WARC records in ZIP packages, written from a table of pages and read back by ranges.

A package is a ZIP archive of stored members: ``archive/data.warc.gz``, in which each record is a gzip member of
its own, ``indexes/index.cdxj``, whose lines hold the sort-friendly URI, the timestamp and a record's range, and ``datapackage.json`` with
the size and SHA-256 of both.  The reader parses the end record, the ZIP64 end record and the central directory,
finds where a stored member's bytes begin from its local header, reads the index, and then reads
each record by its range of the package.  Nothing is extracted.

The first of equal payloads, by page_id, is a ``response`` record; the others are ``revisit``
records that refer to it and keep only the HTTP head, whose Content-Length tells
the payload's size.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import RangeReader, make_folder, open_input, open_output
from .shared import join_unique, materialise, shared_path, small_batches

PACKAGE_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEVEL = 4
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def sort_key(uri: str) -> str:
    """A URI with its host's labels reversed and its scheme left out, in lower case and without spaces; "-" if there is none."""
    host, slash, path = re.sub(r"^[a-z][a-z0-9+.-]*://", "", uri.lower()).partition("/")
    return f"{','.join(reversed(host.split('.')))}){slash}{path}" if uri else "-"


def make_record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit of that page."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one record; a response's payload is checked against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(field["content-length"])]
    if len(block) < int(field["content-length"]):
        raise ValueError("the record ends too soon")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    digest = field["warc-payload-digest"].removeprefix("sha1:")
    kind = field["warc-type"]
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"the payload of {field['warc-record-id']} differs from its digest")
    refers = _PAGE.search(field.get("warc-refers-to", ""))
    return {
        "page_id": int(_PAGE.search(field["warc-record-id"])[1]),
        "url": field.get("warc-target-uri", ""),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": int(refers[1]) if refers else None,
        "payload": payload if kind == "response" else None,
    }


class PackageWriter:
    """Streams records into one package; only its index is held until the end."""

    def __init__(self, uri: str):
        self.uri, self.out = uri, open_output(uri)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data, self.at, self.lines, self.hash = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), 0, [], hashlib.sha256()

    def add(self, page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> None:
        raw = gzip.compress(make_record(page_id, url, payload, refers_to), LEVEL, mtime=0)
        self.data.write(raw)
        self.hash.update(raw)
        self.lines.append((sort_key(_uri(url)), page_id, self.at, len(raw)))
        self.at += len(raw)

    def close(self) -> dict:
        self.data.close()
        hashed, size = hashlib.sha256(), 0
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            for key, page_id, offset, length in sorted(self.lines):
                line = f"{key} {re.sub('[^0-9]', '', DATE)} {json.dumps({'page_id': page_id, 'offset': offset, 'length': length})}\n".encode()
                index.write(line)
                hashed.update(line)
                size += len(line)
        resources = [{"path": DATA, "bytes": self.at, "hash": f"sha256:{self.hash.hexdigest()}"}, {"path": INDEX, "bytes": size, "hash": f"sha256:{hashed.hexdigest()}"}]
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": resources}))
        self.zip.close()
        self.out.close()
        return {"path": self.uri, "n_records": len(self.lines)}


class ZipReader:
    """Members of a ZIP archive by ranges: name -> (local header's offset, size, method)."""

    def __init__(self, f):
        self.f, size = f, f.size()
        tail_at = max(0, size - 65_557)
        tail = self._read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end record: not a ZIP archive")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        where = tail_at + at - 20
        locator = self._read(where, 20) if where >= 0 else b""
        if locator[:4] == b"PK\x06\x07":
            record = self._read(struct.unpack("<Q", locator[8:16])[0], 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 end record isn't where its locator says")
            count, length, start = struct.unpack("<QQQ", record[32:56])
        self.members = dict(self._directory(self._read(start, length), count))

    def _read(self, offset: int, length: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(length)

    @staticmethod
    def _directory(raw: bytes, count: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("the central directory is broken")
            method, packed, size, n_name, n_extra, n_note = *struct.unpack("<H", raw[at + 10 : at + 12]), *struct.unpack("<II", raw[at + 20 : at + 28]), *struct.unpack("<HHH", raw[at + 28 : at + 34])
            offset = struct.unpack("<I", raw[at + 42 : at + 46])[0]
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8")
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack("<HH", extra[:4])
                if kind == 1:  # ZIP64: the fields that don't fit, in this order
                    wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    size = wide.pop(0) if size == 0xFFFFFFFF else size
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
                extra = extra[4 + n :]
            yield name, (offset, size, method)
            at += 46 + n_name + n_extra + n_note

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes within the archive."""
        offset, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed")
        head = self._read(offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        return offset + 30 + sum(struct.unpack("<HH", head[26:30])), size


def read_package(f) -> Iterator[dict]:
    """All records of an open package, in the order of their offsets."""
    archive = ZipReader(f)
    at, length = archive.locate(INDEX)
    base, _ = archive.locate(DATA)
    entries = [json.loads(x.split(b" ", 2)[2]) for x in archive._read(at, length).split(b"\n") if x]
    ranges = RangeReader(f)
    for e in sorted(entries, key=lambda e: e["offset"]):
        yield parse_record(gzip.decompress(ranges.read(base + e["offset"], e["length"])))


def write_packages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write every page as a record of a package; returns ``path, n_records`` of the packages.

    Of records whose payloads are equal and of ``min_bytes`` or more, the one with the smallest
    page_id is a response and the others revisit it; smaller payloads are all responses.  A null page
    is an empty payload and a null url an empty target.  Rows without page_id are left out; rows that repeat
    both page_id and payload are one record.  Other columns are ignored; an empty table
    gives no packages.
    """
    small_batches(pages.sparkSession)
    folder = folder or shared_path(pages.sparkSession, "warc")
    make_folder(folder)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).where("page_id is not null").withColumn("digest", F.sha1("payload"))
    # Only keys are shuffled to find out which records revisit others and which rows are one record.
    keys = source.groupBy("page_id", "digest").agg(F.min("url").alias("only_url"), F.count("*").alias("rows"), F.max(F.octet_length("payload")).alias("size"))
    keys = materialise(keys, "page-keys")
    first = keys.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("response_id"), F.max("page_id").alias("most"), F.count("*").alias("n_rows"))
    light = keys.where(F.col("size") >= min_bytes)
    refers = join_unique(light, first.where("most > response_id").drop("most"), ["digest"], keys.count()).where("page_id > response_id").select("page_id", "digest", "response_id")
    special = keys.join(refers, ["page_id", "digest"], "left").where("response_id is not null or rows > 1").select("page_id", "digest", "only_url", "rows", "response_id")
    special = materialise(special, "page-links")
    once = source.join(special, ["page_id", "digest"], "left").where("rows is null or rows = 1").select("page_id", "url", "payload", "response_id")
    records = once
    if not (repeated := special.where("rows > 1")).isEmpty():
        again = source.join(repeated, ["page_id", "digest"]).groupBy("page_id", "digest").agg(F.min("only_url").alias("url"), F.min("payload").alias("payload"), F.min("response_id").alias("response_id"))
        records = once.unionByName(again.select("page_id", "url", "payload", "response_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            for page_id, url, payload, response in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "response_id"))):
                writer = writer or PackageWriter(f"{folder}/package-{uuid.uuid4().hex}.zip")
                writer.add(page_id.as_py(), url.as_py(), payload.as_py(), response.as_py())
                if writer.at >= PACKAGE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return materialise(records.mapInArrow(run, "path string, n_records long"), "packages")


_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_packages(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the packages of ``path``: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    ``payload`` is null for revisits, and for all if ``payloads`` is false; digests are checked either way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_input(path) as f:
                    rows, size = [], 0
                    for record in read_package(f):
                        size += len(record["payload"] or b"") if payloads else 100
                        rows.append(record if payloads else record | {"payload": None})
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _RECORD)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return packages.select("path").repartition(max(1, packages.count())).mapInArrow(run, schema)  # a package is a task
