"""Sequence packing by sum-of-squares online bin packing.

A task takes the documents of its input split as they come.  Whole windows are
cut off a document first; what is left is a piece smaller than a window.  A
level array counts the partially filled windows of each fill level.  A piece
goes to the fill level that leaves the sum of the squared counts smallest, an
empty window being level 0.  The windows still partially filled when a split
ends are carried, with their ids, to a second pass that places them whole by
the same rule, many splits together.  Only what is partially filled after that
is joined by cutting pieces, so that at most one window per task of the second
pass is left with padding, and none when its length is a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import staged

#: Tokens of a sequence.
CAPACITY = 2048
#: The id that ends each document.
END = 1
#: Sequences numbered by one task.
TASK_BITS = 33
#: Sequences of the second pass are numbered from here.
CARRIED = 1 << 62
#: Tokens of partially filled windows that one task of the second pass takes, about.
CARRY_TOKENS = 1 << 22
OUT_ROWS = 8192
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


class Encoder:
    """Ids of a byte-level BPE file of ``tokenizers``.

    The merges run in tiktoken over the same vocabulary and split pattern,
    several times faster with equal ids; special tokens in a text are read as
    the tokenizer file says.  tiktoken merges by the order of ids, so a file
    whose merges give their pieces in another order is refused.
    """

    def __init__(self, path: str) -> None:
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
        vocabulary = spec["model"]["vocab"]
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)):
            raise ValueError(f"{path}: the ids of merged pieces are not in the order of the merges")
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in piece): k for piece, k in vocabulary.items() if piece not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def __call__(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Piece:
    """A run of one document's ids."""

    __slots__ = ("doc", "doc_tokens", "ids", "start")

    def __init__(self, doc: int | None, doc_tokens: int, start: int, ids: np.ndarray) -> None:
        self.doc, self.doc_tokens, self.start, self.ids = doc, doc_tokens, start, ids

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.doc_tokens, self.start, self.ids[:at]), Piece(self.doc, self.doc_tokens, self.start + at, self.ids[at:])


class SumOfSquares:
    """Partially filled windows by fill level."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, "i8")
        self.open: dict[int, list[list[Piece]]] = {}

    def place(self, pieces: list[Piece]) -> list[Piece] | None:
        """Adds pieces, together smaller than a window, to one window; that window if it is filled."""
        size, capacity, level = sum(len(p.ids) for p in pieces), self.capacity, self.level
        # From level h > 0 to h + size the sum changes by 2 * (level[h + size] - level[h] + 1); a full window no longer counts.
        change = 2 * (level[1 + size :] - level[1 : capacity + 1 - size] + 1)
        if len(change):
            change[-1] = 1 - 2 * level[capacity - size]
            change[level[1 : capacity + 1 - size] == 0] = np.iinfo("i8").max
        best = int(change.argmin()) + 1 if len(change) else 0
        if not best or 2 * level[size] + 1 < change[best - 1]:
            best = 0
        window = self._take(best) + pieces if best else pieces
        if best + size == capacity:
            return window
        self.level[best + size] += 1
        self.open.setdefault(best + size, []).append(window)
        return None

    def _take(self, fill: int) -> list[Piece]:
        self.level[fill] -= 1
        windows = self.open[fill]
        window = windows.pop()
        if not windows:
            del self.open[fill]
        return window

    def close(self) -> Iterator[list[Piece]]:
        """The windows still open, joined into full ones and at most one that is not."""
        left = [(fill, w) for fill in sorted(self.open) for w in self.open[fill]]
        low, high = 0, len(left) - 1
        spare: list[Piece] = []  # of the emptiest windows, to be cut
        while low <= high:
            fill, window = left[high]
            high -= 1
            while fill < self.capacity and (spare or low <= high):
                if not spare:
                    spare = left[low][1]
                    low += 1
                piece = spare.pop()
                if len(piece.ids) > self.capacity - fill:
                    piece, rest = piece.cut(self.capacity - fill)
                    spare.append(rest)
                window.append(piece)
                fill += len(piece.ids)
            yield window
        if spare:
            yield spare
        self.level[:] = 0
        self.open = {}


class Sink:
    """Numbers sequences and gathers their pieces as rows."""

    def __init__(self, first: int) -> None:
        self.sequence = first
        self.rows: list[tuple] = []
        self.ids: list[np.ndarray | None] = []

    def add(self, window: list[Piece], with_ids: bool, is_open: bool = False) -> None:
        offset = 0
        for p in window:
            self.rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.doc_tokens, self.sequence, offset, is_open))
            self.ids.append(p.ids.astype("i4") if with_ids else None)
            offset += len(p.ids)
        self.sequence += 1

    def batch(self) -> pa.RecordBatch:
        *numbers, is_open = zip(*self.rows, strict=True)
        columns = [*(pa.array(c, pa.int64()) for c in numbers), pa.array(is_open, pa.bool_()), pa.array(self.ids, pa.list_(pa.int32()))]
        self.rows, self.ids = [], []
        return pa.RecordBatch.from_arrays(columns, [*NAMES, "open", "ids"])


def _pack_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """First pass: full windows, and those open at the end of the split with their ids."""
    encode, packer = encoder(path), SumOfSquares(capacity)
    sink = Sink(TaskContext.get().partitionId() << TASK_BITS)
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.append(encode(text.as_py() or ""), np.uint32(END))
            whole = len(ids) - len(ids) % capacity
            for start in range(0, whole, capacity):
                sink.add([Piece(doc, len(ids), start, ids[start : start + capacity])], with_ids)
            if whole < len(ids) and (full := packer.place([Piece(doc, len(ids), whole, ids[whole:].copy())])):
                sink.add(full, with_ids)
            if len(sink.rows) >= OUT_ROWS:
                yield sink.batch()
    for fill in sorted(packer.open):
        for window in packer.open[fill]:
            sink.add(window, True, True)
        if len(sink.rows) >= OUT_ROWS:
            yield sink.batch()
    if sink.rows:
        yield sink.batch()


def _carry_batches(batches: Iterator[pa.RecordBatch], capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Second pass over the pieces of open windows, by sequence and offset: places each window whole, joins what stays open."""
    packer, sink = SumOfSquares(capacity), Sink(CARRIED + (TaskContext.get().partitionId() << TASK_BITS))
    window: list[Piece] = []
    last = None

    def settle() -> None:
        if window and (full := packer.place(list(window))):
            sink.add(full, with_ids)
        window.clear()

    for batch in batches:
        docs, starts, totals, sequences = (batch.column(NAMES.index(n)).to_pylist() for n in ("doc_id", "start", "doc_tokens", "sequence_id"))
        for k, ids in enumerate(batch.column(len(NAMES) + 1)):
            if sequences[k] != last:
                settle()
                last = sequences[k]
            window.append(Piece(docs[k], totals[k], starts[k], ids.values.to_numpy().astype("u4")))
        if len(sink.rows) >= OUT_ROWS:
            yield sink.batch()
    settle()
    for joined in packer.close():
        sink.add(joined, with_ids)
        if len(sink.rows) >= OUT_ROWS:
            yield sink.batch()
    if sink.rows:
        yield sink.batch()


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for.

    A sequence is its pieces' ids by offset, padded to ``capacity`` unless its
    length is a power of two.

    Null text is empty, which is the closing id alone; rows repeated under one
    doc_id are packed like any others; of fill levels that serve equally well
    the lowest is taken, an empty window last; an empty table gives no rows.
    Each input split is packed by itself without a shuffle, and its outcome is
    written; only the windows left open, at most a few per fill level and
    split, are dealt again.  ``tokenizer`` is the path of a byte-level BPE
    file, the same on every machine.
    """
    schema = SCHEMA + ", open boolean, ids array<int>"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = staged(own.mapInArrow(lambda it: _pack_batches(it, tokenizer, capacity, with_ids), schema), "packed")
    tokens = first.where("open").agg(F.sum("length")).first()[0] or 0
    carried = first.where("open").repartition(1 + tokens // CARRY_TOKENS, "sequence_id").sortWithinPartitions("sequence_id", "offset")
    second = carried.mapInArrow(lambda it: _carry_batches(it, capacity, with_ids), schema)
    return first.where("NOT open").unionByName(second).select(*NAMES, *(["ids"] if with_ids else []))
