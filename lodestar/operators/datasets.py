"""Training-data operators: splits, preference pairs, chat rows, context and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions import text as T
from lodestar.operators.order import running


def group_split(rows: DataFrame, group: str, ratio: float, seed: str) -> DataFrame:
    """(group, n, split): whole groups go to eval, in the order of sha1(seed:group), until it has round(n * ratio) rows.

    The first group always does, unless it is the only one; a group that would
    empty the training part is skipped.  Groups are ordered, not rows, and not
    in one task.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("__h", F.sha1(F.concat_ws(":", F.lit(seed), F.col(group).cast("string"))))
    placed = running(sizes, ["__h", group], "n")
    total = sizes.agg(F.sum("n").alias("__total"))
    placed = placed.crossJoin(F.broadcast(total))
    taken = ((F.col("__before") < F.round(F.col("__total") * ratio)) | (F.col("__place") == 1)) & (F.col("__before") + F.col("n") < F.col("__total"))
    return placed.select(group, "n", F.when(taken, "eval").otherwise("train").alias("split"))


def stratified_split(rows: DataFrame, stratum: str, key: str, ratio: float, seed: str) -> DataFrame:
    """(key, stratum, split): of every stratum round(n * ratio) keys go to eval, one at least and never all; of a stratum of one row none does.

    They are the first in the order of sha1(seed:key).  Which they are is told
    by their place in the order of all rows (stratum, hash), less the rows of
    the strata before, so that a hot stratum is not sorted in one task.
    """
    own = rows.select(key, F.coalesce(F.col(stratum).cast("string"), F.lit("unknown")).alias("__stratum"), F.col(stratum).alias("__given"), F.sha1(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))).alias("__h"))
    placed = running(own, ["__stratum", "__h", key])
    sizes = placed.groupBy("__stratum").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    wanted = F.when(F.col("__n") > 1, F.least(F.greatest(F.lit(1), F.bround(F.col("__n") * ratio)), F.col("__n") - 1)).otherwise(0) if ratio > 0 else F.lit(0)
    placed = placed.join(sizes, "__stratum")
    return placed.select(key, F.col("__given").alias(stratum), F.when(F.col("__place") - F.col("__first") < wanted, "eval").otherwise("train").alias("split"))


def chat_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, first_role, messages): the turns of a conversation in order, as role: text lines."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.size("m").cast("long").alias("n_turns"), F.col("m")[0]["role"].alias("first_role"), F.array_join(F.transform("m", lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n").alias("messages"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, chosen, rejected, hardness): an answer against the answer to the question before it in the conversation."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = turns.select("conv_id", "turn", "role", "text", F.lag("text").over(w).alias("prompt"), F.lag("role").over(w).alias("asker"), F.lag("text", 2).over(w).alias("rejected"), F.lag("role", 2).over(w).alias("other"))
    pairs = rows.where("role = 'assistant' AND asker = 'user' AND other = 'assistant'").select("conv_id", "turn", "prompt", F.col("text").alias("chosen"), "rejected")
    return pairs.withColumn("hardness", hardness(F.col("chosen"), F.col("rejected")))


def hardness(a, b):
    """0.7 token Jaccard + 0.3 ratio of the numbers of different tokens, to four places; 0 if a side has none."""
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(T.WORD), F.lit(0)))
    x, y = words(a), words(b)
    some = (F.size(x) > 0) & (F.size(y) > 0)
    return F.when(some, F.round(0.7 * T.jaccard(x, y) + 0.3 * F.least(F.size(x), F.size(y)) / F.greatest(F.size(x), F.size(y)), 4)).otherwise(0.0)


def content_key(*columns):
    """SHA-1 of the columns as JSON: equal rows have equal keys."""
    return F.sha1(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def previous_context(turns: DataFrame, most: int | None = None) -> DataFrame:
    """(conv_id, turn, n_before, chars_before): what came before each turn in its conversation."""
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding if most is None else -most, -1)
    return turns.select("conv_id", "turn", F.count("text").over(w).alias("n_before"), F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("chars_before"))


def within_budget(rows: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose whole texts fit ``budget`` letters together: the first that does not fit ends it."""
    upto = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("__upto", F.sum(F.coalesce(F.length(text), F.lit(0))).over(upto)).where(F.col("__upto") <= budget).drop("__upto")


def robust_scores(rows: DataFrame, group: str, value: str) -> DataFrame:
    """``rows`` with z: tanh of the clipped robust z-score within the group, of the value itself in groups of one.

    The median and the median of the distances are aggregates joined back, so
    a hot group is summarised before it is joined.
    """
    mid = rows.groupBy(group).agg(F.median(value).alias("__mid"), F.count(F.lit(1)).alias("__n"))
    with_mid = rows.join(mid, group)
    mad = with_mid.groupBy(group).agg(F.median(F.abs(F.col(value) - F.col("__mid"))).alias("__mad"))
    z = (F.col(value) - F.col("__mid")) / F.greatest(1.4826 * F.col("__mad"), F.lit(1e-4))
    clipped = F.greatest(F.least(z, F.lit(2.5)), F.lit(-2.5))
    return with_mid.join(mad, group).withColumn("z", F.tanh(F.when(F.col("__n") > 1, clipped / 1.5).otherwise(F.col(value)))).drop("__mid", "__mad", "__n")


def audit(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, mean, std, low, high): population statistics per group."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once; must be empty."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def errors(rows: DataFrame, key: str, checks: dict) -> DataFrame:
    """(key, error): one row per failed check, from conditions that say what is wrong."""
    found = F.array_compact(F.array(*(F.when(wrong, F.lit(message)) for message, wrong in checks.items())))
    return rows.select(key, F.explode(found).alias("error"))


def best_images(cases: DataFrame, k: int) -> DataFrame:
    """Per key, the k rows of the largest relevance, given back in their own order as an array of items."""
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("relevance"), "pos"))
    kept = cases.withColumn("__rank", rank).where(F.col("__rank") <= k)
    return kept.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items"))
