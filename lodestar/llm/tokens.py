"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton gives every vocabulary piece that occurs in a word.
The dynamic programme keeps, for each place in the word, the best score of a
segmentation that ends there and how many pieces that one has; no pieces are
built.  A place takes the first of equally good candidates, that is the
longest piece, as the tokenizer does; runs of unknown characters count as one
unknown piece, or as their bytes where the vocabulary falls back to bytes.

Pieces never cross a word, so each different word of a task is searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Below the smallest score by this much is an unknown character.
UNKNOWN_PENALTY = 10.0
#: The mark before each word, in place of blanks.
MARK = "▁"
#: Words whose counts a worker remembers.
CACHE_WORDS = 500_000
#: Longer words are not remembered.
CACHE_LETTERS = 64


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model file, without unknown, control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [(model.id_to_piece(k), model.get_score(k)) for k in ids if not (model.is_unknown(k) or model.is_control(k) or model.is_byte(k) or model.is_unused(k))]


class UnigramCounter:
    """Counts the pieces of the best segmentation."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.cache: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of one word, its mark included."""
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, found in self.automaton.iter(word):
            ending[last + 1].append(found)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)
        unknown = [False] * (n + 1)
        for end in range(1, n + 1):
            top = None
            single = False
            for size, score in sorted(ending[end], reverse=True):  # the longest starts first
                single |= size == 1
                value = best[end - size] + score
                if top is None or value > top:
                    top, source = value, end - size
            if not single:
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    best[end], unknown[end] = value, True
                    cost = len(word[end - 1].encode()) if self.byte_fallback else 0 if unknown[end - 1] else 1
                    count[end] = count[end - 1] + cost
                    continue
            best[end], count[end] = top, count[source] + 1
        return count[n]

    def text(self, text: str) -> int:
        """Pieces of a text: blanks become marks, one more stands before it, and each mark begins a word."""
        if not text:
            return 0
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        total = 0
        words = text.replace(" ", MARK).split(MARK)
        if words[0] == "" and text[0] in (" ", MARK):  # a mark stands there already
            words = words[1:]
        for word in words:
            got = cache.get(word)
            if got is None:
                got = self.word(MARK + word)
                if len(word) <= CACHE_LETTERS:
                    cache[word] = got
            total += got
        return total


_COUNTERS: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(vocabulary(path))
    return _COUNTERS[path]


def _count_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = counter(path)
    for batch in batches:
        counts = [own.text(t.as_py() or "") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_tokens): one row per row of ``docs``; null and empty texts have no tokens.

    The vocabulary file is the same on every machine; of a BPE file only the
    pieces and their scores are read, as a unigram vocabulary.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _count_batches(it, vocabulary_path), "doc_id long, n_tokens long")
