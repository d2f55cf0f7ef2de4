"""WARC records in ZIP packages, written and read by range.

A package is a ZIP archive with stored (uncompressed) members: WARC data, one
gzip member per record, and an index with a line per record.  The reader
parses the end record, the ZIP64 records and the central directory itself,
locates the members, and reads each record by its byte range; nothing is
extracted.  Packages are read and written through ``pyarrow.fs``, so they may
lie on any store that driver and executors share.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import shutil
import struct
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import discard, scratch_path, staged

#: Smaller payloads are never revisits.
REVISIT_BYTES = 100
#: A task begins another package beyond so many bytes.
PACKAGE_BYTES = 256 << 20
#: Neighbouring records are read together up to so many bytes.
RANGE_BYTES = 4 << 20
#: Payload bytes given out at once.
OUT_BYTES = 8 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ID = "urn:page:"

# -- packages -------------------------------------------------------------------

END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"


class Member(NamedTuple):
    name: str
    start: int  # of its bytes in the package
    size: int


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def members(file: pa.NativeFile) -> dict[str, Member]:
    """The stored members of a package by name."""
    size = file.size()
    tail = file.read_at(min(size, 65_557 + 20), max(0, size - 65_557 - 20))
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("not a ZIP archive: no end record")
    count, length, start = struct.unpack_from("<10xHII", tail, at)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        if at < 20 or tail[at - 20 : at - 16] != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        (where,) = struct.unpack_from("<8xQ", tail, at - 20)
        record = file.read_at(56, where)
        if record[:4] != END64:
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<32xQQQ", record)
    directory, out, at = file.read_at(length, start), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        method, packed, plain, n_name, n_extra, n_comment, header = struct.unpack_from("<10xH8xIIHHH8xI", directory, at)
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        at += 46 + n_name + n_extra + n_comment
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:  # 64-bit fields, only those that do not fit, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        if method:
            continue
        fixed = file.read_at(30, header)
        if fixed[:4] != LOCAL:
            raise ValueError(f"damaged header of {name}")
        n_name, n_extra = struct.unpack_from("<26xHH", fixed)
        out[name] = Member(name, header + 30 + n_name + n_extra, packed)
    return out


class PackageWriter:
    """Builds one package in the task's own folder and puts it on the shared store when closed."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        self.own = tempfile.NamedTemporaryFile(prefix="package-")  # noqa: SIM115
        self.zip = zipfile.ZipFile(self.own, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, record: bytes, entry: dict) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.index.append(json.dumps(entry | {"offset": self.size, "length": len(packed)}))
        self.data.write(packed)
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        size = self.own.tell()
        self.own.seek(0)
        store, path = opened(self.uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(path) as out:
            shutil.copyfileobj(self.own, out, 1 << 20)
        self.own.close()
        return self.uri, len(self.index), size


# -- records ----------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit without payload that names the response."""
    safe = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>"]
    if safe:
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, rest


def _page(value: str | None) -> int | None:
    number = (value or "").strip("<>").removeprefix(ID)
    return int(number) if number else None


class Read(NamedTuple):
    page_id: int | None
    url: str | None
    payload: bytes | None
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None


def parsed(packed: bytes) -> Read:
    """A record from its gzip member; a response is held against its digest."""
    head, rest = _headers(gzip.decompress(packed))
    http, payload = _headers(rest[: int(head["content-length"])])
    digest, size = head["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"])
    if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {head['warc-record-id']}")
    return Read(_page(head["warc-record-id"]), head.get("warc-target-uri"), payload if head["warc-type"] == "response" else None, size, digest, head["warc-type"], _page(head.get("warc-refers-to")))


def records(uri: str) -> Iterator[Read]:
    """All records of a package, by the ranges of its index."""
    store, path = opened(uri)
    with store.open_input_file(path) as file:
        found = members(file)
        data, index = found[DATA], found[INDEX]
        entries = [json.loads(line) for line in file.read_at(index.size, index.start).decode().split("\n") if line]
        first = 0
        while first < len(entries):
            low = high = entries[first]["offset"]
            last = first
            while last < len(entries) and entries[last]["offset"] == high and (last == first or high - low < RANGE_BYTES):
                high += entries[last]["length"]
                last += 1
            chunk = file.read_at(high - low, data.start + low)
            for e in entries[first:last]:
                yield parsed(chunk[e["offset"] - low : e["offset"] - low + e["length"]])
            first = last


# -- tables -----------------------------------------------------------------------

MANIFEST = "uri string, records long, bytes long"
SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _write_batches(batches: Iterator[pa.RecordBatch], folder: str, most: int) -> Iterator[pa.RecordBatch]:
    writer, done = None, []
    for batch in batches:
        for page_id, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), batch.column(3).to_pylist(), strict=True):
            writer = writer or PackageWriter(folder)
            writer.add(record(page_id, url, html.as_py() or b"", refers_to), {"id": page_id})
            if writer.size >= most:
                done.append(writer.close())
                writer = None
    if writer:
        done.append(writer.close())
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["uri", "records", "bytes"])


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def given(rows: list[Read]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(Read._fields))

    for batch in batches:
        for uri in batch.column(0).to_pylist():
            rows, size = [], 0
            for row in records(uri):
                rows.append(row)
                size += len(row.payload or b"") + 200
                if size >= OUT_BYTES:
                    yield given(rows)
                    rows, size = [], 0
            if rows:
                yield given(rows)


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id of the same payload, null if that is the row's own.

    Payloads below ``least`` bytes refer to nothing.  Null html is empty; a
    null page_id is never referred to and refers to nothing; rows repeated
    under one page_id are alike.

    Payloads meet as digests: a payload that makes up a third of all pages is
    first summed up to its smallest id, a written table, and the join with it
    is one of ids and digests that adaptive execution may split.  Pages, with
    their html, are joined by page_id and digest with what that gave, and short
    ones are in neither table.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    long = staged(own.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", F.unhex(F.sha2("html", 256)).alias("sha")), "digests")
    firsts = staged(long.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").select("sha", "refers_to"), "first-pages")
    revisits = staged(long.join(firsts, "sha").where("page_id <> refers_to").distinct(), "revisits")
    return own.withColumn("sha", F.unhex(F.sha2("html", 256))).join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "html", "refers_to")


def write_packages(pages: DataFrame, folder: str, least: int = REVISIT_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes one record per row of ``pages`` (page_id, url, html) and returns the manifest: uri, records, bytes.

    The manifest is a written table.  A task that is repeated writes packages
    of other names, and only those of the task that ended are listed.
    """
    spark = pages.sparkSession
    rows = with_revisits(pages, least)
    rows.mapInArrow(lambda it: _write_batches(it, folder, package_bytes), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_packages(manifest: DataFrame) -> DataFrame:
    """The records of all packages that ``manifest`` lists, a package per task."""
    return manifest.select("uri").repartition(max(1, manifest.count())).mapInArrow(_read_batches, SCHEMA)


def round_trip(spark: SparkSession, pages: DataFrame, columns: tuple[str, ...] = Read._fields) -> DataFrame:
    """``columns`` of ``pages`` written to packages in the shared folder and read back.

    What was read is a written table; the packages are removed.
    """
    folder = scratch_path(spark, "warc")
    try:
        return staged(read_packages(write_packages(pages, folder)).select(*columns), "pages")
    finally:
        discard(spark, folder)
