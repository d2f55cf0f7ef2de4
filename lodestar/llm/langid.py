"""Language identification by a linear-chain conditional random field over words.

Each word gets features of its affixes, its character n-grams and a learned
lexicon, the words that several training documents use and nearly all of them
in one language; transitions between the languages of neighbouring words are learned
too, from training sequences that are spliced where languages switch.  The
forward-backward algorithm gives every word a probability per language, so
that code-switched text is labelled word by word; a document takes the
language with the largest mean probability.

The chain runs within blocks of :data:`CHAIN` words, so that many blocks are
labelled at once; all words of a text count.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import fresh, remainder_of_id

#: Labelled documents to learn from, at most; of each, all words.
TRAIN_ROWS = 1000
#: A word is in the lexicon of a language if so many training documents use it ...
LEXICON_DOCS = 2
#: ... and this share of them are in that language.
LEXICON_SHARE = 0.9
#: Words of a chain.
CHAIN = 48
#: Feature weights per language; the lexicons' features follow them.
FEATURES = 1 << 17
#: Words whose scores a worker remembers.
CACHE_WORDS = 300_000
#: Words labelled at once, about: a multiple of the chain.
AT_ONCE = CHAIN * 2500
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def features(words: list[str], lexicon: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) pairs of lower-case words: hashed prefixes and suffixes of up to four letters, n-grams of up to three with the edges, the word, and the language whose lexicon has it.

    All words are hashed together, as arrays of code points; a run of letters
    hashes to the same feature wherever it stands, by kind and length.
    """
    edged = [f"^{w}$" for w in words]
    size = np.fromiter(map(len, edged), "i8", len(edged))
    start = np.r_[0, np.cumsum(size)[:-1]]
    code = np.frombuffer("".join(edged).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - start[owner]
    owners, hashes = [], []
    power = np.uint64(0x9E3779B97F4A7C15)

    def add(kind: int, at: np.ndarray, length: int) -> None:
        with np.errstate(over="ignore"):
            value = np.full(len(at), kind, "u8")
            for k in range(length):
                value = value * power + code[at + k]
            hashes.append(_mix(value))
        owners.append(owner[at])

    for n in (1, 2, 3):
        add(n, np.flatnonzero(place + n <= size[owner]), n)
    for n in (1, 2, 3, 4):
        long = np.flatnonzero(size >= n + 2)
        add(10 + n, start[long] + 1, n)
        add(20 + n, start[long] + size[long] - 1 - n, n)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, power, "u8"))
        whole = np.add.reduceat(code * powers[place], start) if len(words) else np.empty(0, "u8")
        hashes.append(_mix(whole ^ np.uint64(99)))
    owners.append(np.arange(len(words)))
    slots = (np.concatenate(hashes) >> np.uint64(20)).astype("i8") % FEATURES
    listed = [(k, FEATURES + lexicon[w]) for k, w in enumerate(words) if w in lexicon] if lexicon else []
    if listed:
        owners.append(np.array([k for k, _ in listed], "i8"))
        slots = np.r_[slots, [f for _, f in listed]]
    return np.concatenate(owners), slots


class Chain:
    """Weights of a trained field, and its lexicon: the number of the language of each word."""

    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray, start: np.ndarray, lexicon: dict[str, int] | None = None) -> None:
        self.labels, self.weights, self.moves, self.start, self.lexicon = labels, weights, moves, start, lexicon or {}


def lexicon_of(texts: list[tuple[list[str], int]]) -> dict[str, int]:
    """The words that at least :data:`LEXICON_DOCS` texts (words, label number) use, :data:`LEXICON_SHARE` of them of one label, with that label."""
    counts: dict[str, dict[int, int]] = {}
    for words, label in texts:
        for word in set(words):
            own = counts.setdefault(word, {})
            own[label] = own.get(label, 0) + 1
    out = {}
    for word, own in counts.items():
        label, most = max(own.items(), key=lambda x: (x[1], -x[0]))
        if sum(own.values()) >= LEXICON_DOCS and most >= LEXICON_SHARE * sum(own.values()):
            out[word] = label
    return out


def marginals(emit: np.ndarray, real: np.ndarray, moves: np.ndarray, start: np.ndarray, count: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains: label probabilities (chain, place, label) and, if ``count``, the expected moves.

    ``emit`` (chain, place, label) are scores, ``real`` (chain, place) marks the
    places in use, which come first.
    """
    n, size, k = emit.shape
    gain = np.exp(emit - emit.max(2, keepdims=True))
    gain[~real] = 1.0
    step = np.exp(moves)
    ahead = np.empty((n, size, k))
    now = np.exp(start) * gain[:, 0]
    ahead[:, 0] = now / now.sum(1, keepdims=True)
    for t in range(1, size):
        now = (ahead[:, t - 1] @ step) * gain[:, t]
        now /= now.sum(1, keepdims=True)
        ahead[:, t] = np.where(real[:, t, None], now, ahead[:, t - 1])
    back = np.ones((n, k))
    out = np.empty((n, size, k))
    out[:, -1] = ahead[:, -1]
    expected = np.zeros((k, k))
    for t in range(size - 2, -1, -1):
        beyond = gain[:, t + 1] * back
        live = real[:, t + 1]
        if count:
            both = ahead[:, t, :, None] * step * beyond[:, None, :]
            both /= both.sum((1, 2), keepdims=True)
            expected += both[live].sum(0)
        new = beyond @ step.T
        back = np.where(live[:, None], new / new.sum(1, keepdims=True), back)
        now = ahead[:, t] * back
        out[:, t] = now / now.sum(1, keepdims=True)
    return out, expected


def train(texts: list[tuple[str, str]], seed: int = 7, rounds: int = 4) -> Chain:
    """A field from (text, label) pairs by stochastic gradient ascent on the likelihood (AdaGrad)."""
    labels = sorted({label for _, label in texts})
    number = {label: k for k, label in enumerate(labels)}
    rng = np.random.default_rng(seed)
    known: dict[str, int] = {}
    runs: list[tuple[list[int], int]] = []
    split = [(WORD.findall(text.lower()), label) for text, label in texts]
    lexicon = lexicon_of([(words, number[label]) for words, label in split])
    for words, label in split:
        for at in range(0, len(words), CHAIN // 2):
            own = []
            for word in words[at : at + CHAIN // 2]:
                own.append(known.setdefault(word, len(known)))
            runs.append((own, number[label]))
    k = max(len(labels), 1)
    slots = FEATURES + len(labels)
    weights, moves, start = np.zeros((slots, k), "f4"), np.zeros((k, k)), np.zeros(k)
    if not runs:
        return Chain(labels, weights, moves, start)
    owners, hashed = features(list(known), lexicon)
    order = np.argsort(owners, kind="stable")
    lists = np.split(hashed[order], np.cumsum(np.bincount(owners, minlength=len(known)))[:-1])
    square_w, square_m, square_s = np.full((slots, k), 1e-6, "f4"), np.full((k, k), 1e-6), np.full(k, 1e-6)
    for _ in range(rounds):
        order = rng.permutation(len(runs))
        pairs = [order[i : i + 2] for i in range(0, len(order), 2)]  # two runs, often of two languages, are one chain
        for first in range(0, len(pairs), 32):
            batch = pairs[first : first + 32]
            words = np.zeros((len(batch), CHAIN), "i8")
            gold = np.full((len(batch), CHAIN), -1, "i8")
            for c, pair in enumerate(batch):
                at = 0
                for r in pair:
                    own, label = runs[r]
                    words[c, at : at + len(own)], gold[c, at : at + len(own)] = own, label
                    at += len(own)
            real = gold >= 0
            used, place = np.unique(words[real], return_inverse=True)
            flat = np.concatenate([lists[w] for w in used])
            sizes = np.array([len(lists[w]) for w in used])
            owner = np.repeat(np.arange(len(used)), sizes)
            edges = np.r_[0, np.cumsum(sizes)[:-1]]
            scores = np.add.reduceat(weights[flat], edges, axis=0)
            emit = np.zeros((*words.shape, k))
            emit[real] = scores[place]
            likely, expected = marginals(emit, real, moves, start)
            wrong = -likely
            wrong[real, gold[real]] += 1
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, place, wrong[real])
            hit, where = np.unique(flat, return_inverse=True)
            slope = np.zeros((len(hit), k))
            np.add.at(slope, where, by_word[owner])
            slope -= 1e-3 * weights[hit]
            square_w[hit] += slope**2
            weights[hit] += 0.2 * slope / np.sqrt(square_w[hit])
            seen = np.zeros((k, k))
            pair_real = real[:, 1:]
            np.add.at(seen, (gold[:, :-1][pair_real], gold[:, 1:][pair_real]), 1)
            slope_m = seen - expected
            square_m += slope_m**2
            moves += 0.1 * slope_m / np.sqrt(square_m)
            slope_s = wrong[:, 0].sum(0)
            square_s += slope_s**2
            start += 0.1 * slope_s / np.sqrt(square_s)
    return Chain(labels, weights, moves, start, lexicon)


class Labeller:
    """Labels texts; remembers the scores of the words seen, up to a bound."""

    def __init__(self, chain: Chain) -> None:
        self.chain = chain
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.empty((1024, len(self.chain.labels)), "f4")

    def _add(self, words: list[str]) -> None:
        need = len(self.known) + len(words)
        if need > len(self.scores):
            self.scores = np.concatenate([self.scores, np.empty((need, self.scores.shape[1]), "f4")])
        owner, found = features(words, self.chain.lexicon)
        first = len(self.known)
        for k in range(self.scores.shape[1]):
            self.scores[first:need, k] = np.bincount(owner, self.chain.weights[found, k], len(words))
        self.known |= {word: first + k for k, word in enumerate(words)}

    def word_probabilities(self, texts: list[list[str]]) -> list[np.ndarray]:
        """(word, language) probabilities for each list of lower-case words."""
        if len(self.known) > CACHE_WORDS:
            self._clear()
        known = self.known
        fresh = set().union(*texts).difference(known)
        if fresh:
            self._add(sorted(fresh))
        sizes = [len(words) for words in texts]
        ids = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(texts)), "i8", sum(sizes))
        out = np.empty((len(ids), len(self.chain.labels)))
        ends = np.cumsum(sizes)
        begins, lengths = [], []
        for size, end in zip(sizes, ends, strict=True):
            for at in range(end - size, end, CHAIN):
                begins.append(at)
                lengths.append(min(CHAIN, end - at))
        begins, lengths = np.array(begins, "i8"), np.array(lengths, "i8")
        for at in range(0, len(begins), 2048):
            b, n = begins[at : at + 2048], lengths[at : at + 2048]
            place = b[:, None] + np.arange(n.max())
            real = np.arange(n.max()) < n[:, None]
            emit = self.scores[ids[np.where(real, place, 0)]].astype("f8")
            likely, _ = marginals(emit, real, self.chain.moves, self.chain.start, count=False)
            out[place[real]] = likely[real]
        return np.split(out, ends[:-1]) if sizes else []

    def runs(self, text: str | None) -> list[dict]:
        """Runs of neighbouring words whose likeliest language is the same."""
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.chain.labels:
            return []
        likely = np.concatenate([self.word_probabilities([words[at : at + AT_ONCE]])[0] for at in range(0, len(words), AT_ONCE)])
        best = likely.argmax(1)
        starts = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
        ends = np.r_[starts[1:], len(best)]
        return [{"first_word": int(a), "last_word": int(b) - 1, "lang": self.chain.labels[best[a]], "score": float(likely[a:b, best[a]].mean())} for a, b in zip(starts, ends, strict=True)]

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of each text and its mean probability; ``und``, 0.0 for null and texts without a letter."""
        total, count = np.zeros((len(texts), max(1, len(self.chain.labels)))), np.zeros(len(texts), "i8")
        own: list[int] = []
        lists: list[list[str]] = []

        def settle() -> None:
            for k, likely in zip(own, self.word_probabilities(lists), strict=True):
                total[k] += likely.sum(0)
                count[k] += len(likely)
            own.clear()
            lists.clear()

        held = 0
        for k, text in enumerate(texts if self.chain.labels else ()):
            words = WORD.findall(text.lower()) if text else []
            if not any(c.isalpha() for w in words for c in w):
                continue
            for at in range(0, len(words), AT_ONCE):  # a very long text comes in parts
                own.append(k)
                lists.append(words[at : at + AT_ONCE])
                held += len(lists[-1])
                if held >= AT_ONCE:
                    settle()
                    held = 0
        settle()
        mean = total / np.maximum(count, 1)[:, None]
        best = mean.argmax(1)
        return [(self.chain.labels[best[k]], float(min(1.0, mean[k, best[k]]))) if count[k] else (UNKNOWN, 0.0) for k in range(len(texts))]


_LABELLERS: dict[str, Labeller] = {}


def _labeller(name: str, chain) -> Labeller:
    if name not in _LABELLERS:  # a worker keeps the latest model
        _LABELLERS.clear()
        _LABELLERS[name] = Labeller(chain.value)
    return _LABELLERS[name]


def _label_batches(batches: Iterator[pa.RecordBatch], name: str, chain, columns: list[str]) -> Iterator[pa.RecordBatch]:
    labeller = _labeller(name, chain)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        found = labeller.label(texts)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names, *columns])


def learn(docs: DataFrame, rows: int = TRAIN_ROWS) -> Chain:
    """A field from at most ``rows`` documents with a lang whose crc32(doc_id) mod 3 is not 1, drawn by a hash of the id.

    Their whole texts reach the driver.  Of rows repeated under one id the one
    with the least text counts.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder_of_id("doc_id", 3) != 1))
    key = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("long").alias("id"))
    last = labelled.select(key.alias("key")).orderBy("key").limit(rows).agg(F.max("key").alias("key")).first()
    if last is None or last.key is None:
        return train([])
    bound = F.struct(F.lit(last.key.h).cast("long").alias("h"), F.lit(last.key.id).cast("long").alias("id"))
    one = labelled.where(key <= bound).groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row"))
    return train(sorted((r.text, r.lang) for r in one.select("row.*").toLocalIterator()))


def identify(docs: DataFrame, chain: Chain, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the language and its mean probability; all rows stay, and all columns but those of the two names, which are replaced.

    ``und`` with score 0 for null texts and texts without a letter.
    """
    spark = docs.sparkSession
    rest = docs.drop(label, score)
    model = spark.sparkContext.broadcast(chain)
    name = f"{spark.sparkContext.applicationId}-{zlib.crc32(chain.weights.tobytes() + chain.moves.tobytes())}"
    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in rest.schema), T.StructField(label, T.StringType()), T.StructField(score, T.DoubleType())])
    return rest.mapInArrow(lambda it: _label_batches(it, name, model, [label, score]), schema)


RUN = "array<struct<first_word:int,last_word:int,lang:string,score:double>>"


def _run_batches(batches: Iterator[pa.RecordBatch], name: str, chain) -> Iterator[pa.RecordBatch]:
    labeller = _labeller(name, chain)
    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("last_word", pa.int32()), ("lang", pa.string()), ("score", pa.float64())]))
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([labeller.runs(t) for t in batch.column(1).to_pylist()], kind)], ["doc_id", "runs"])


def label_words(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, runs): the runs of words (from 0, both ends included) of one language each, with their mean probability.

    Words are runs of letters.  Texts without letters, and null texts, have no
    runs.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(chain)
    name = f"{spark.sparkContext.applicationId}-{zlib.crc32(chain.weights.tobytes() + chain.moves.tobytes())}"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: _run_batches(it, name, model), f"doc_id long, runs {RUN}")


#: A document is rejected when no language has this mean probability.
CERTAIN = 0.3


def drop_unidentified(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` without those that are ``und`` or of no certain language; keeps the columns."""
    label, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    return identify(docs, chain, label, score).where((F.col(label) != UNKNOWN) & (F.col(score) >= CERTAIN)).select(docs.columns)
