"""Temporal events: order, splits, counts, overrides and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.order import running

#: Shares of the training and validation parts.
TRAIN, VALID = 0.70, 0.85


def triplets(events: DataFrame) -> DataFrame:
    """Event rows as (event_id, subject, predicate, object, ts, day, value): user, type and key of the properties."""
    key = F.get_json_object("props", "$.k")
    return events.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("predicate"), F.concat(F.lit("k"), key).alias("object"), "ts", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")


def edge_counts(rows: DataFrame) -> DataFrame:
    """(subject, predicate, object, total_count, active_days, first_day, last_day, mean_value): one row per edge."""
    return rows.groupBy("subject", "predicate", "object").agg(F.count(F.lit(1)).alias("total_count"), F.countDistinct("day").alias("active_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.avg("value").alias("mean_value"))


def event_copies(edge_days: DataFrame) -> DataFrame:
    """Each edge and day with n events becomes n copies of weight n: strength grows with the square of the count."""
    return edge_days.select("subject", "predicate", "object", "day", F.col("n").cast("double").alias("weight"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))


def chronological_split(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with split train, valid or test by position in the order of ``keys``, which no single task sorts."""
    placed = running(rows, keys)
    total = rows.agg(F.count(F.lit(1)).alias("__n"))
    train = F.greatest(F.lit(1), F.floor(F.col("__n") * TRAIN))
    valid = F.greatest(train, F.floor(F.col("__n") * VALID))
    split = F.when(F.col("__place") <= train, "train").when(F.col("__place") <= valid, "valid").otherwise("test")
    return placed.crossJoin(F.broadcast(total)).withColumn("split", split).drop("__before", "__place", "__n")


def apply_overrides(edges: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Edges with expert_weight: the sum of the weights of their overrides, 0 without."""
    total = overrides.groupBy(*keys).agg(F.sum("weight").alias("expert_weight"))
    return edges.join(total, keys, "left").withColumn("expert_weight", F.coalesce("expert_weight", F.lit(0.0)))


# Weights of verdicts; others count 0.
VERDICT_WEIGHTS = {"accept": 1.0, "accepted": 1.0, "reject": -1.0, "rejected": -1.0, "needs_time_fix": -0.25, "needs_evidence_fix": -0.25, "added": 0.75, "uncertain": 0.0}


def verdict_weight(verdict):
    out = F.lit(0.0)
    for name, weight in VERDICT_WEIGHTS.items():
        out = F.when(verdict == name, weight).otherwise(out)
    return out


def corrected(rows: DataFrame, corrections: DataFrame, key: str, fields: list[str], order: str | None = None) -> DataFrame:
    """Old and new versions: a corrected row stays with status replaced and gets one successor that carries the new fields.

    A correction changes the fields that it gives; the others stay.  One that
    gives none changes nothing.  Of several for one key the last by ``order``
    counts (by their fields, if there is no order).
    """
    given = corrections.where(F.coalesce(*(F.col(f).cast("string") for f in fields)).isNotNull())
    last = F.struct(*fields) if order is None else F.col(order)
    new = given.groupBy(key).agg(F.max_by(F.struct(*fields), last).alias("__new"))
    joined = rows.join(new, key, "left")
    changed = F.col("__new").isNotNull()
    old = joined.withColumn("status", F.when(changed, "replaced").otherwise("current")).withColumn("version", F.lit(1))
    after = joined.where(changed).withColumns({f: F.coalesce(F.col(f"__new.{f}"), F.col(f)) for f in fields}).withColumn("status", F.lit("current")).withColumn("version", F.lit(2))
    return old.unionByName(after).drop("__new")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: the last row per key in the order of ``order``; grouped, not sorted."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("__row")).select(*keys, "__row.*")


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Order-preserving dedup: the first row per key in the order of ``order``."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__row")).select(*keys, "__row.*")


def bitemporal(start, end, valid_from, valid_to):
    """evidence:a..b|valid:c..d with unknown and +inf for what is missing; dates stay strings."""
    none = lambda x, word: F.coalesce(F.nullif(x, F.lit("")), F.lit(word))
    return F.concat(F.lit("evidence:"), none(start, "unknown"), F.lit(".."), none(end, "unknown"), F.lit("|valid:"), none(valid_from, "unknown"), F.lit(".."), none(valid_to, "+inf"))
