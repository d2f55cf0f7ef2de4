"""Exact nearest neighbours of stated query vectors, blends and rank fusion."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Query vectors compared in one pass: with their numbers they are a bounded broadcast.
BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(metric: str, a: Column, b: Column) -> Column:
    """cosine, dot, l2 or l1; larger is nearer."""
    if metric == "cosine":
        both = norm(a) * norm(b)
        return F.when(both > 0, dot(a, b) / both).otherwise(0.0)
    if metric == "dot":
        return dot(a, b)
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    if metric == "l2":
        return -F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x))
    return -F.aggregate(gaps, F.lit(0.0), lambda s, x: s + F.abs(x))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list array as a matrix of ``dim`` columns; shorter vectors and null numbers are filled with zeros, longer vectors cut."""
    rows = [v.as_py() or [] for v in column] if column.null_count else None
    if rows is None:
        flat, ends = column.flatten(), np.asarray(column.offsets)
        sizes = np.diff(ends)
        if not flat.null_count and len(sizes) and (sizes == dim).all():
            return np.asarray(flat).astype("f8").reshape(len(sizes), dim)
        rows = column.to_pylist()
    out = np.zeros((len(rows), dim))
    for k, row in enumerate(rows):
        own = [0.0 if x is None else x for x in row[:dim]]
        out[k, : len(own)] = own
    return out


def _scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(query, vector) scores; larger is nearer."""
    if metric in ("cosine", "dot"):
        out = q @ x.T
        if metric == "cosine":
            both = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)
            out = np.divide(out, both, out=np.zeros_like(out), where=both > 0)
        return out
    out = np.empty((len(q), len(x)))
    for k, own in enumerate(q):
        gap = x - own
        out[k] = -np.sqrt((gap * gap).sum(1)) if metric == "l2" else -np.abs(gap).sum(1)
    return out


def _near_batches(batches: Iterator[pa.RecordBatch], queries, k: int, metric: str) -> Iterator[pa.RecordBatch]:
    """Of every batch the rows that may be among the ``k`` nearest of each query."""
    ids, q = queries.value
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.asarray(batch.column(0))
        scores = np.round(_scores(metric, q, _matrix(batch.column(1), q.shape[1])), 6)
        scores[ids[:, None] == own] = -np.inf
        if scores.shape[1] > k:
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            keep = (scores >= least[:, None]) & np.isfinite(scores)  # all that tie with the last one stay
        else:
            keep = np.isfinite(scores)
        row, col = np.nonzero(keep)
        yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(own[col]), pa.array(scores[row, col])], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest other vectors of each query, ties by vec_id.

    Queries are taken in blocks of at most ``block`` rows (by a hash of their
    id, counted first), each a broadcast matrix of that bound, which every batch
    of vectors is multiplied with.  A batch gives out its own k best per query,
    so what is dealt by query and ranked does not grow with the vectors of a
    batch.  Vectors shorter than the queries are filled with zeros, longer ones
    cut.
    """
    spark = vectors.sparkSession
    numbered = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("q"))
    blocks, largest = 1, numbered.count()
    while largest > block:
        blocks = max(2 * blocks, -(-2 * largest // block))
        largest = numbered.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks))).count().agg(F.max("count")).first()[0]
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    schema = "query_id long, vec_id long, score double"
    out = None
    for number in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).collect()  # at most `block` vectors: counted above
        if not rows:
            continue
        dim = max(len(r.q or []) for r in rows)
        matrix = _matrix(pa.array([r.q for r in rows], pa.list_(pa.float64())), dim)
        held = spark.sparkContext.broadcast((np.array([r.query_id for r in rows], "i8"), matrix))
        near = own.mapInArrow(lambda it, held=held: _near_batches(it, held, k, metric), schema)
        out = near if out is None else out.union(near)
    if out is None:
        return spark.createDataFrame([], schema + ", rank int")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def blend(a: Column, b: Column, share: float = 0.7) -> Column:
    """share * a + (1 - share) * b, the shorter one padded with zeros."""
    zero = F.lit(0.0)
    return F.zip_with(a, b, lambda x, y: share * F.coalesce(x.cast("double"), zero) + (1 - share) * F.coalesce(y.cast("double"), zero))


def fused(left: DataFrame, right: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """(query_id, vec_id, score, rank): reciprocal rank fusion of two ranked lists."""
    a = left.select("query_id", "vec_id", (1.0 / (constant + F.col("rank"))).alias("a"))
    b = right.select("query_id", "vec_id", (1.0 / (constant + F.col("rank"))).alias("b"))
    both = a.join(b, ["query_id", "vec_id"], "full_outer").select("query_id", "vec_id", F.round(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 9).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def hashed(rows: DataFrame, key: str, tokens: str, dim: int = 384) -> DataFrame:
    """(key, slot, value): signed feature hashing of a token array by MD5, scaled to unit length.

    The slot is the number of the first eight hexadecimal digits modulo
    ``dim``; an odd ninth digit makes the sign negative.  Each row is hashed by
    itself, without a shuffle, in Arrow batches: array functions of Spark that
    add up by slot within a row took five times as long as the three exchanges
    that they were to save.  ``key`` tells the rows apart; nulls are no tokens.
    """
    return _unit_slots(rows, key, tokens, dim, signed=True)


def hashed_counts(rows: DataFrame, key: str, tokens: str, dim: int = 2048) -> DataFrame:
    """(key, slot, value): unsigned counts by slot, scaled to unit length, otherwise as :func:`hashed`."""
    return _unit_slots(rows, key, tokens, dim, signed=False)


#: Numbers added up at once, rows times slots.
SLOTS_AT_ONCE = 1 << 20


def _slot_batches(batches: Iterator[pa.RecordBatch], dim: int, signed: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, SLOTS_AT_ONCE // dim)
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            lists = part.column(1)
            owner, words = pc.list_parent_indices(lists), lists.flatten().dictionary_encode()
            different = words.dictionary.to_pylist()
            digests = [hashlib.md5(w.encode()).hexdigest() for w in different]
            slot = np.array([int(d[:8], 16) % dim for d in digests], "i8")
            sign = np.array([-1.0 if signed and int(d[8], 16) % 2 else 1.0 for d in digests])
            known = np.asarray(words.indices.is_valid())
            at = np.asarray(words.indices.fill_null(0)).astype("i8")[known]
            place = np.asarray(owner).astype("i8")[known] * dim
            if not len(at):
                continue
            sums = np.bincount(place + slot[at], sign[at], part.num_rows * dim).reshape(part.num_rows, dim)
            length = np.sqrt((sums * sums).sum(1))
            row, col = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(col), pa.array(sums[row, col] / length[row])], names)


def _unit_slots(rows: DataFrame, key: str, tokens: str, dim: int, signed: bool) -> DataFrame:
    names = [key, "slot", "value"]
    return rows.select(key, tokens).mapInArrow(lambda it: _slot_batches(it, dim, signed, names), f"{key} {dict(rows.dtypes)[key]}, slot long, value double")


def _blake_slots(texts: pd.Series, dim: int, signed: bool) -> pd.Series:
    out = []
    for words in texts:
        sums = [0.0] * dim
        for word in [] if words is None else words:
            digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
            if signed:
                number = int.from_bytes(digest, "big")
                sums[number % dim] += -1.0 if number & 1 else 1.0
            else:
                sums[int.from_bytes(digest, "little") % dim] += 1.0
        length = math.sqrt(sum(x * x for x in sums)) or 1.0
        out.append([x / length for x in sums])
    return pd.Series(out)


def blake_vectors(rows: DataFrame, key: str, tokens: str, dim: int = 384, signed: bool = True) -> DataFrame:
    """(key, embedding): dense vectors of BLAKE2b hashes, which Spark has no expression for, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def slots(words: pd.Series) -> pd.Series:
        return _blake_slots(words, dim, signed)

    return rows.select(key, slots(tokens).alias("embedding"))


def write_index(vectors: DataFrame, path: str, metric: str = "cosine") -> None:
    """An index of (vec_id, embedding, payload) below ``path``: the vectors, cut or filled to one length, and one row of metadata."""
    spark = vectors.sparkSession
    dim = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    own = vectors.withColumn("embedding", F.slice(F.concat(F.transform("embedding", lambda x: F.coalesce(x.cast("float"), F.lit(0.0).cast("float"))), F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, max(dim, 1)))
    own.write.mode("overwrite").parquet(f"{path}/vectors")
    spark.createDataFrame([(metric, dim, vectors.count())], "metric string, dim int, items long").write.mode("overwrite").parquet(f"{path}/meta")


def search_index(spark, path: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank, payload): the k nearest items of an index for each query vector (vec_id, embedding)."""
    meta = spark.read.parquet(f"{path}/meta").first()
    vectors = spark.read.parquet(f"{path}/vectors")
    found = nearest(vectors, queries, k, meta.metric)
    return found.join(vectors.select("vec_id", "payload"), "vec_id").select("query_id", "vec_id", "score", "rank", "payload")


def filtered_search(hits: DataFrame, kinds: DataFrame, kind: str, k: int) -> DataFrame:
    """Of the 2k nearest of each query those of one kind, k at most, so that there may be fewer; ``kinds``: vec_id, kind."""
    kept = hits.where(F.col("rank") <= 2 * k).join(kinds.where(F.col("kind") == kind).select("vec_id"), "vec_id", "left_semi")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("place", place).where(F.col("place") <= k)
