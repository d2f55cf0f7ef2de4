"""Precision and recall of triplets, verdict accuracy, gates and paired reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T

KEY = ("subject", "predicate", "object")


def _keyed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*more, F.concat_ws("|", *(T.norm(F.coalesce(c, F.lit(""))) for c in KEY)).alias("key"))


def by_case(predicted: DataFrame, gold: DataFrame, case: str) -> DataFrame:
    """(case, n_gold, n_pred, precision, recall, f1): every prediction counts, so duplicates can lift recall above 1.

    Gold keys count once.  A hot case is summed up before the two sides meet.
    """
    p = _keyed(predicted, case).groupBy(case, "key").agg(F.count(F.lit(1)).alias("n"))
    g = _keyed(gold, case).distinct().withColumn("gold", F.lit(1))
    both = p.join(g, [case, "key"], "full_outer")
    sums = both.groupBy(case).agg(F.count("gold").alias("n_gold"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pred"), F.coalesce(F.sum(F.when(F.col("gold").isNotNull(), F.col("n"))), F.lit(0)).alias("matched"))
    precision, recall = F.col("matched") / F.greatest("n_pred", F.lit(1)), F.col("matched") / F.greatest("n_gold", F.lit(1))
    return sums.withColumns({"precision": precision, "recall": recall}).withColumn("f1", F.when(F.col("matched") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)).drop("matched")


def corpus(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: precision, recall and F1 over the sets of keys."""
    p, g = _keyed(predicted).distinct().withColumn("p", F.lit(1)), _keyed(gold).distinct().withColumn("g", F.lit(1))
    row = p.join(g, "key", "full_outer").agg(F.count("p").alias("n_pred"), F.count("g").alias("n_gold"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("matched"))
    return row.select("n_pred", "n_gold", "matched", (F.col("matched") / F.greatest("n_pred", F.lit(1))).alias("precision"), (F.col("matched") / F.greatest("n_gold", F.lit(1))).alias("recall"), (2 * F.col("matched") / F.greatest(F.col("n_pred") + F.col("n_gold"), F.lit(1))).alias("f1"))


def verdict_accuracy(predicted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """One row: gold rows, those with the same verdict, and the share."""
    both = gold.select(key, F.col("verdict").alias("want")).join(predicted.select(key, F.col("verdict").alias("got")), key, "left")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("want") == F.col("got")).alias("same")).withColumn("accuracy", F.col("same") / F.greatest("n", F.lit(1)))


def paired(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """(key, verdict_a, verdict_b, status): cases of two reviews by id; the last of a repeated id wins."""
    last = lambda x, name: x.groupBy(key).agg(F.max_by("verdict", order).alias(name))
    both = last(a, "verdict_a").join(last(b, "verdict_b"), key, "full_outer")
    return both.withColumn("status", F.when(F.col("verdict_a").isNull(), "only_b").when(F.col("verdict_b").isNull(), "only_a").when(F.col("verdict_a") == F.col("verdict_b"), "same").otherwise("differs"))


def gates(metrics: DataFrame, bounds: dict[str, tuple[str, float]]) -> DataFrame:
    """(gate, value, bound, passed) from one row of metrics; bounds are (>= or <=, number)."""
    rows = F.array(*(F.struct(F.lit(name).alias("gate"), F.col(name).cast("double").alias("value"), F.lit(float(limit)).alias("bound"), (F.col(name) >= limit if way == ">=" else F.col(name) <= limit).alias("passed")) for name, (way, limit) in bounds.items()))
    return metrics.select(F.explode(rows).alias("g")).select("g.*")


def without_output(sources: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, n): rows per source, 0 for those that gave none."""
    return sources.select(key).distinct().join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").na.fill(0, ["n"])


def agreement(rows: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: confusion counts of two boolean columns, precision, recall, F1, accuracy and Cohen's kappa; 0 where a share has no base."""
    p, a = F.col(predicted), F.col(actual)
    c = rows.agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"), F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    share = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    seen, by_chance = (tp + tn) / n, ((tp + fp) / n) * ((tp + fn) / n) + ((fn + tn) / n) * ((fp + tn) / n)
    return c.select("tp", "fp", "fn", "tn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2.0 * tp, 2 * tp + fp + fn).alias("f1"), seen.alias("accuracy"), F.when(by_chance < 1, (seen - by_chance) / (1 - by_chance)).otherwise(0.0).alias("kappa"))


def evidence_recall(predicted: DataFrame, gold: DataFrame, case: str) -> DataFrame:
    """(case, n_gold, n_found, recall): different pieces of gold evidence (case, source_id) that the answers cite."""
    g = gold.select(case, "source_id").distinct()
    found = g.join(predicted.select(case, "source_id").distinct().withColumn("hit", F.lit(1)), [case, "source_id"], "left")
    return found.groupBy(case).agg(F.count(F.lit(1)).alias("n_gold"), F.count("hit").alias("n_found")).withColumn("recall", F.col("n_found") / F.col("n_gold"))


def time_accuracy(predicted: DataFrame, gold: DataFrame, case: str) -> DataFrame:
    """(case, n, same, accuracy): of the matched triplets with a time in the gold, those whose start and end are alike."""
    times = [F.coalesce(F.lower(F.trim(c)), F.lit("")).alias(c) for c in ("start", "end")]
    p = _keyed(predicted, case, "start", "end").groupBy(case, "key").agg(F.min(F.struct(*times)).alias("got"))
    g = _keyed(gold, case, "start", "end").where(F.coalesce("start", F.lit("")) != "").groupBy(case, "key").agg(F.min(F.struct(*times)).alias("want"))
    return g.join(p, [case, "key"]).groupBy(case).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("got") == F.col("want")).alias("same")).withColumn("accuracy", F.col("same") / F.col("n"))
