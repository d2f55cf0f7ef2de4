"""Benchmark decontamination by Wu-Manber search over words.

The test strings are word windows of the benchmark.  For windows of one length
a shift table on blocks of two words says how far the search may jump, a
bucket per suffix block holds the windows that can end at a place, and a direct
comparison confirms each of them.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import fresh, staged

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text that one pass over the documents searches for; its tables take some 50 times as much in a worker.
BLOCK_BYTES = 4 << 20
#: Every byte outside [0-9a-z] and the bytes of non-ASCII characters separates words; A-Z become a-z.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TO_WORDS).split()


class WuManber:
    """Word windows of one length with the items that each belongs to.

    ``source`` is one list of words that all windows are slices of: a window is
    its place there, and no table holds words of its own.
    """

    def __init__(self, length: int, source: list[bytes], windows: dict[int, tuple[int, ...]]) -> None:
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.source, self.items = source, windows
        self.shift: dict = {}
        self.bucket: dict = {}
        for place in windows:
            for end in range(self.block, length + 1):
                block = self._key(source, place + end)
                self.shift[block] = min(self.shift.get(block, self.default), length - end)
            self.bucket.setdefault(self._key(source, place + length), []).append(place)

    def _key(self, words: list[bytes], end: int):
        return (words[end - 2], words[end - 1]) if self.block == 2 else words[end - 1]

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(start, items) of every occurrence, by start."""
        at, n, length, two = self.length, len(words), self.length, self.block == 2
        shift, default, source = self.shift.get, self.default, self.source
        while at <= n:
            block = (words[at - 2], words[at - 1]) if two else words[at - 1]
            jump = shift(block, default)
            if jump:
                at += jump
                continue
            start = at - length
            for place in self.bucket[block]:
                if words[start] == source[place] and words[start:at] == source[place : place + length]:
                    yield start, self.items[place]
                    break  # equal windows share one place
            at += 1


def searchers(items: list[tuple[int | None, bytes | None]], window: int = WINDOW) -> list[WuManber]:
    """One searcher per window length; an item of fewer words is one window."""
    source: list[bytes] = []
    same: dict[bytes, bytes] = {}
    places: dict[int, dict[bytes, int]] = {}
    found: dict[int, dict[int, set[int]]] = {}
    for item, text in items:
        words = [same.setdefault(w, w) for w in words_of(text)]
        length, first = min(window, len(words)), len(source)
        source += words
        for start in range(len(words) - length + 1 if length else 0):
            run = hashlib.blake2b(b" ".join(words[start : start + length]), digest_size=16).digest()
            place = places.setdefault(length, {}).setdefault(run, first + start)
            own = found.setdefault(length, {}).setdefault(place, set())
            if item is not None:
                own.add(item)
    del places, same
    alike: dict[tuple[int, ...], tuple[int, ...]] = {}
    out = []
    for length in sorted(found):
        windows = {place: alike.setdefault(key, key) for place, ids in found.pop(length).items() for key in (tuple(sorted(ids)),)}
        out.append(WuManber(length, source, windows))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


_BUILT: dict[str, list[WuManber]] = {}


def _search_batches(batches: Iterator[pa.RecordBatch], name: str, items, window: int) -> Iterator[pa.RecordBatch]:
    """Adds what this block of items hits to the spans and items found so far (the last two columns)."""
    if name not in _BUILT:  # a worker keeps the tables of the latest block
        _BUILT.clear()
        _BUILT[name] = searchers(items.value, window)
    tables = _BUILT[name]
    for batch in batches:
        where = batch.schema.get_field_index("text")
        spans_out, items_out = [], []
        old = zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True)
        for text, (spans, found) in zip(batch.column(where).cast(pa.binary()), old, strict=True):
            words = words_of(text.as_py())
            hits = [(s["start"], s["end"]) for s in spans.as_py()]
            ids = set(found.as_py())
            for table in tables:
                for start, own in table.search(words):
                    if hits and hits[-1][1] >= start >= hits[-1][0]:
                        hits[-1] = (hits[-1][0], max(hits[-1][1], start + table.length))
                    else:
                        hits.append((start, start + table.length))
                    ids.update(own)
            spans_out.append([{"start": a, "end": b} for a, b in _merged(hits)] if hits else [])
            items_out.append(sorted(ids))
        spans = pa.array(spans_out, batch.schema.field(batch.num_columns - 2).type)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], spans, pa.array(items_out, pa.list_(pa.int64()))], schema=batch.schema)


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int | None, bytes | None]]]:
    """The items in blocks of at most ``most`` bytes (a larger item alone), one at a time on the driver."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).where("text IS NOT NULL")
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((item, bytes(text)))
        size += len(text)
    if block:
        yield block


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, spans: str = "hit_spans", items: str = "hit_items") -> DataFrame:
    """``docs`` with two columns more: runs of hit words (from 0, end exclusive) and sorted item ids.

    ``docs`` needs a text column and keeps all its columns but those of the
    two names ``spans`` and ``items``, which are replaced.  Null texts have no words.  Items without
    words match nothing, those without an id hit words but are not listed.
    Repeated rows get equal results; ties do not arise.  The benchmark is
    searched in blocks of ``block_bytes``: each is a bounded broadcast and one
    more narrow pass over the documents.  What a pass but the last gives is a
    written table, so that a worker holds the tables of one block only.
    """
    spark = docs.sparkSession
    out = docs.drop(spans, items)
    out = out.withColumn(spans, F.expr("CAST(array() AS array<struct<start:bigint,end:bigint>>)")).withColumn(items, F.expr("CAST(array() AS array<bigint>)"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])
    for k, block in enumerate(_blocks(benchmark, block_bytes)):
        if k:
            out = staged(out, "passages")
        held = spark.sparkContext.broadcast(block)
        name = f"{spark.sparkContext.applicationId}-{uuid.uuid4().hex}-{k}"
        out = out.mapInArrow(lambda it, name=name, held=held: _search_batches(it, name, held, window), schema)
    return out


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, spans, items = (batch.column(k) for k in range(4))
        n_words = [len(words_of(t.as_py())) for t in texts.cast(pa.binary())]
        n_hit = [sum(s["end"] - s["start"] for s in row) for row in spans.to_pylist()]
        found = items.to_pylist()
        shas = [hashlib.sha256(",".join(sorted(map(str, row))).encode()).hexdigest() for row in found]
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(row) for row in found], pa.int64()), pa.array(shas), pa.array([n > 0 for n in n_hit])], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def passage_digests(found: DataFrame) -> DataFrame:
    """Counts and a digest of the items per row of :func:`find_passages`."""
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "hit_spans", "hit_items").mapInArrow(_digest_batches, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents in which a benchmark window occurs; keeps the columns."""
    spans, items = fresh(docs, "hit_spans"), fresh(docs, "hit_items")
    return find_passages(docs, benchmark, window, spans=spans, items=items).where(F.size(spans) == 0).select(docs.columns)
