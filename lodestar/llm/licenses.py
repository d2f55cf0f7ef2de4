"""License scans: exact phrases and fuzzy short notices.

A notice that may have k edits is cut into k + 1 seeds; a text in which it
occurs contains one of them unchanged.  Seeds are found by plain search, and
around each the ``regex`` library looks for the whole notice with at most k
edits, which gives its span and its number of edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Exact phrases and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices and their labels (fixed values).
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "mozilla public license version 2 0": "mpl-2.0",
    "creative commons attribution sharealike": "cc-by-sa",
}
#: One edit per so many letters of a notice.
LETTERS_PER_EDIT = 12
#: Every byte outside [0-9a-z] and of non-ASCII characters becomes a blank; A-Z become a-z.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Notice:
    """A notice with its seeds and its bounded-error expression."""

    def __init__(self, text: str, label: str, letters_per_edit: int = LETTERS_PER_EDIT) -> None:
        self.text, self.label = text.encode(), label
        self.edits = len(text) // letters_per_edit
        edges = [len(self.text) * k // (self.edits + 1) for k in range(self.edits + 2)]
        self.seeds = [(self.text[a:b], a) for a, b in zip(edges, edges[1:], strict=False)]
        self.search = regex.compile(rb"(?<![^ ])(?:%s){e<=%d}(?![^ ])" % (regex.escape(text).encode(), self.edits), regex.BESTMATCH)

    def places(self, text: bytes, at: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """(start, end, edits) of the occurrences around seeds ``at`` (place, place of the seed in the notice)."""
        size, k = len(self.text), self.edits
        done = -1
        for place, offset in sorted(at):
            if place < done:
                continue
            low, high = max(0, place - offset - k - 1), min(len(text), place - offset + size + k + 1)
            low, high = text.rfind(b" ", 0, low + 1) + 1, text.find(b" ", high)
            high = len(text) if high < 0 else high
            found = self.search.search(text, low, high)
            if found:
                done = found.end()
                yield found.start(), found.end(), sum(found.fuzzy_counts)


class Scanner:
    """Finds phrases and notices in texts of words."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str]) -> None:
        import ahocorasick

        self.phrases = [(p.encode(), label) for p, label in phrases.items()]
        self.notices = [Notice(t, label) for t, label in notices.items()]
        self.seeds = ahocorasick.Automaton()
        by_seed: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(self.notices):
            for seed, offset in notice.seeds:
                by_seed.setdefault(seed.decode("latin-1"), []).append((n, offset))
        for seed, uses in by_seed.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()

    def base(self, joined: bytes) -> list[tuple[int, str]]:
        """(byte place, label) of every phrase in a text of words with a blank on either side."""
        out = []
        for phrase, label in self.phrases:
            sought, at = b" " + phrase + b" ", -1
            while (at := joined.find(sought, at + 1)) >= 0:
                out.append((at + 1, label))
        return out

    def fuzzy(self, joined: bytes) -> list[tuple[int, int, str, int]]:
        """(start, end, label, edits) of every notice; of those that overlap, the one with fewer edits for its length."""
        at: dict[int, list[tuple[int, int]]] = {}
        for last, (size, uses) in self.seeds.iter(joined.decode("latin-1")):
            for n, offset in uses:
                at.setdefault(n, []).append((last + 1 - size, offset))
        found = []
        for n, places in at.items():
            notice = self.notices[n]
            found += [(edits / len(notice.text), -len(notice.text), start, end, notice.label, edits) for start, end, edits in notice.places(joined, places)]
        out: list[tuple[int, int, str, int]] = []
        for _, _, start, end, label, edits in sorted(found):
            if all(end <= s or start >= e for s, e, _, _ in out):
                out.append((start, end, label, edits))
        return sorted(out)


_SCANNERS: dict[tuple, Scanner] = {}


def scanner(phrases: dict[str, str], notices: dict[str, str]) -> Scanner:
    key = (*phrases.items(), *notices.items())
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(phrases, notices)
    return _SCANNERS[key]


SCHEMA = "doc_id long, n_words long, hits array<struct<label:string,base:boolean,first_word:long,last_word:long,edits:int>>"


def _scan_batches(batches: Iterator[pa.RecordBatch], phrases: dict[str, str], notices: dict[str, str]) -> Iterator[pa.RecordBatch]:
    own = scanner(phrases, notices)
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32())]))
    for batch in batches:
        n_words, hits = [], []
        for text in batch.column(1).cast(pa.binary()):
            words = (text.as_py() or b"").translate(TO_WORDS).split()
            joined = b" " + b" ".join(words) + b" "
            n_words.append(len(words))
            found = [(at, at + 1, label, True, 0) for at, label in own.base(joined)]
            found += [(start, end, label, False, edits) for start, end, label, edits in own.fuzzy(joined)]
            row, word, upto = [], 0, 1
            for start, end, label, base, edits in sorted(found):
                word, upto = word + joined.count(b" ", upto, start), start
                row.append({"label": label, "base": base, "first_word": word, "last_word": word + joined.count(b" ", start, end), "edits": edits})
            hits.append(row)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(hits, kind)], ["doc_id", "n_words", "hits"])


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, hits): one row per row of ``docs``.

    hits: label, whether it is an exact phrase, its first and last word (from
    0) and its edits, by place.  Null and empty texts have no words; rows
    repeated, and extra columns, change nothing.  Of notices that overlap the
    one with fewer edits for its length stays, of those that tie the longer, then
    the earlier one; exact phrases stay whatever they overlap.
    """
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _scan_batches(it, phrases, notices), SCHEMA)
