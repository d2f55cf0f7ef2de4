"""Exact deduplication by Grace hashing.

Records are partitioned by the hash of their content.  A bucket is loaded into
an open-addressing table that compares complete contents; when the different
contents of a bucket exceed the memory budget, it is partitioned again by
further bits of the hash into spill files, and so on.  This runs twice: over
every input split, so that copies in a split shrink to one row, and, after the
rows left are dealt by hash, over every bucket of the whole.  A text that makes
up a third of all rows reaches a bucket at most once per input split.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fresh, staged

#: Bytes of different contents that a table may hold.
TABLE_BYTES = 64 << 20
#: Spill files that a bucket is cut into, as bits of the hash.
FAN_BITS = 4
#: Rows given out at once.
OUT_ROWS = 4096
#: Bytes that one more record of a content already seen counts against the budget.
TAG_BYTES = 64
SPACE = re.compile(rb"[\x20\x09-\x0D]+")
HEAD = struct.Struct("<QQI")
LAST = 1 << 63


def normalised(text: bytes) -> bytes:
    return SPACE.sub(b" ", text)


class ContentTable:
    """Open addressing with linear probing over complete contents."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def index(self, key: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = key & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == key and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        self.slots[at] = entry = len(self.hashes)
        self.hashes.append(key)
        self.contents.append(content)
        self.bytes += len(content) + 64
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, key in enumerate(self.hashes):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _spilled(path: str) -> Iterator[tuple[int, bytes, int]]:
    with open(path, "rb", buffering=1 << 18) as file:
        while head := file.read(HEAD.size):
            key, tag, size = HEAD.unpack(head)
            yield key, file.read(size), tag


def grace(records: Iterator[tuple[int, bytes, int]], budget: int = TABLE_BYTES, level: int = 0) -> Iterator[tuple[ContentTable, list[list[int]]]]:
    """Tables over all records (hash, content, tag) with the tags of each content; equal contents share an entry.

    ``budget`` bounds the contents and tags in memory (one content may exceed it alone).
    """
    content_table, tags = ContentTable(), []
    records = iter(records)
    for key, content, tag in records:
        entry = content_table.index(key, content)
        if entry == len(tags):
            tags.append([])
        tags[entry].append(tag)
        content_table.bytes += TAG_BYTES
        if content_table.bytes > budget and len(tags) > 1 and (level + 1) * FAN_BITS <= 64:
            break
    else:
        if tags:
            yield content_table, tags
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        paths = [os.path.join(folder, f"{k:02d}") for k in range(1 << FAN_BITS)]
        files = [open(p, "wb", buffering=1 << 16) for p in paths]  # noqa: SIM115
        shift, mask = 64 - (level + 1) * FAN_BITS, (1 << FAN_BITS) - 1

        def put(key: int, content: bytes, tag: int) -> None:
            file = files[key >> shift & mask]
            file.write(HEAD.pack(key, tag, len(content)))
            file.write(content)

        for entry, own in enumerate(tags):
            for tag in own:
                put(content_table.hashes[entry], content_table.contents[entry], tag)
        del content_table, tags
        for record in records:
            put(*record)
        for file in files:
            file.close()
        for path in paths:
            yield from grace(_spilled(path), budget, level + 1)
            os.unlink(path)


LOCAL = "row long, doc_id long, rep long, text_sha256 string, rep_doc long, copies long, hash long, content binary"


def _local_batches(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """One row per record; of equal ones in the split, that with the smallest doc_id carries the content."""
    rows: list[int] = []
    ids: list[int | None] = []

    def records():
        for batch in batches:
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                content = normalised(text.as_py() or b"")
                rows.append(row)
                ids.append(doc_id)
                yield xxhash.xxh64_intdigest(content), content, len(rows) - 1

    names = [part.split()[0] for part in LOCAL.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def given(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for content_table, tags in grace(records(), budget):
        out, size = [], 0
        for entry, own in enumerate(tags):
            content = content_table.contents[entry]
            sha = hashlib.sha256(content).hexdigest()
            head = min(own, key=lambda t: (ids[t] is None, ids[t] or 0, rows[t]))
            for tag in own:
                if tag == head:
                    key = content_table.hashes[entry]
                    out.append((rows[tag], ids[tag], rows[head], sha, ids[tag], len(own), key - (1 << 64) if key >= LAST else key, content))
                    size += len(content)
                else:
                    out.append((rows[tag], ids[tag], rows[head], sha, None, None, None, None))
                if len(out) >= OUT_ROWS or size >= 4 << 20:
                    yield given(out)
                    out, size = [], 0
        if out:
            yield given(out)


WHOLE = "rep long, keep long, keep_id long, group_size long"


def _whole_batches(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """For the first of each split: the first of the whole, and the size of the group."""
    seen: list[tuple[int, int | None, int]] = []

    def records():
        for batch in batches:
            rep, doc, copies, hashes = (batch.column(k).to_pylist() for k in range(4))
            for k, content in enumerate(batch.column(4)):
                seen.append((rep[k], doc[k], copies[k]))
                yield hashes[k] & (1 << 64) - 1, content.as_py(), len(seen) - 1

    for _, tags in grace(records(), budget):
        out = []
        for own in tags:
            keep, keep_id, _ = min((seen[t] for t in own), key=lambda s: (s[1] is None, s[1] or 0, s[0]))
            total = sum(seen[t][2] for t in own)
            out += [(seen[t][0], keep, keep_id, total) for t in own]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["rep", "keep", "keep_id", "group_size"])


def _groups(numbered: DataFrame, budget: int) -> DataFrame:
    """:func:`duplicate_groups` of rows (row, doc_id, text) whose numbers are their own."""
    local = staged(numbered.mapInArrow(lambda it: _local_batches(it, budget), LOCAL), "grace")
    firsts = local.where("copies IS NOT NULL").select("rep", "rep_doc", "copies", "hash", "content").repartition("hash")
    whole = firsts.mapInArrow(lambda it: _whole_batches(it, budget), WHOLE)
    kept = (F.col("copies").isNotNull() & (F.col("rep") == F.col("keep"))).alias("kept")
    return local.select("row", "doc_id", "rep", "copies", "text_sha256").join(whole, "rep").select("row", "doc_id", "keep_id", "group_size", kept, "text_sha256")


def duplicate_groups(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256): one row per row of ``docs``.

    Texts are equal when identical after each run of blanks is one space; null
    counts as empty.  The row with the smallest doc_id stays (a null doc_id
    only if the group has no other; of rows repeated under one doc_id, the
    first).  ``row`` numbers the rows of this result and means nothing outside
    it: it is given once, in the scan whose outcome is written.  ``budget``:
    bytes of text a task holds.
    """
    return _groups(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), budget)


def drop_duplicates(docs: DataFrame, budget: int = TABLE_BYTES) -> DataFrame:
    """``docs`` without the rows whose text an earlier document has; keeps the columns.

    Null texts are empty, and equal to each other; of repeated rows one stays;
    an empty table gives an empty one.  The rows are numbered once, in a
    written table that both the search and the result read: numbers given in
    two scans agree only while both are split alike, which executors that come
    and go change.
    """
    row = fresh(docs, "row")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = _groups(numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), budget)
    gone = staged(groups.where("NOT kept").select(F.col("row").alias(row)), "duplicates")
    return numbered.join(gone, row, "left_anti").select(docs.columns)
