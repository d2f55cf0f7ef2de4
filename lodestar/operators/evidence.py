"""Evidence for claims: assets near a source, assertions about an entity, triggers and hard negatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.operators.datasets import content_key, hardness

#: Pages by which an asset may be away from what cites it.
BAND = 1


def pages_of(locator: Column, most: int = 6) -> Column:
    """Pages that a locator names, ranges spelt out to at most ``most`` pages each: p. 3, pp. 4-6."""
    text = F.lower(F.coalesce(locator, F.lit("")))
    pattern = r"\bp(?:p|ages?|\.)?\.?\s*([0-9]+)(?:\s*[-–]\s*([0-9]+))?"
    first = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    last = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    ranges = F.zip_with(first, last, lambda a, b: F.sequence(a.cast("int"), F.greatest(a.cast("int"), F.least(F.coalesce(F.nullif(b, F.lit("")).cast("int"), a.cast("int")), a.cast("int") + most - 1))))
    return F.array_distinct(F.flatten(ranges))


def assets_for(sources: DataFrame, assets: DataFrame, fallback: int = 3) -> DataFrame:
    """(source_id, asset_id, how): assets of the same paper within a page, or that the locator names; else the first ``fallback``, images before others.

    ``sources``: source_id, ref, page, locator; ``assets``: asset_id, ref,
    page, kind, label.  Pages meet by equality: a source looks for its page and
    the two beside it, so a paper of many assets makes no pairs of all of them.
    """
    around = F.transform(F.sequence(F.lit(-BAND), F.lit(BAND)), lambda k: F.col("page") + k)
    looked = sources.select("source_id", "ref", "locator", F.explode(F.array_distinct(F.concat(F.coalesce(around, F.array().cast("array<int>")), pages_of(F.col("locator"))))).alias("page")).distinct()
    near = looked.join(assets.select("asset_id", "ref", "page"), ["ref", "page"]).select("source_id", "asset_id").distinct().withColumn("how", F.lit("page"))
    named = sources.where(F.trim("locator") != "").select("source_id", "ref", F.lower(F.trim("locator")).alias("label")).join(assets.select("asset_id", "ref", F.lower(F.trim("label")).alias("label")), ["ref", "label"]).select("source_id", "asset_id", F.lit("label").alias("how"))
    found = near.unionByName(named).groupBy("source_id", "asset_id").agg(F.min("how").alias("how"))
    best = W.partitionBy("ref").orderBy((F.col("kind") != "image"), F.coalesce("page", F.lit(10_000)), "asset_id")
    first = assets.withColumn("k", F.row_number().over(best)).where(F.col("k") <= fallback).select("ref", "asset_id")
    rest = sources.join(found.select("source_id").distinct(), "source_id", "left_anti").join(first, "ref").select("source_id", "asset_id", F.lit("fallback").alias("how"))
    return found.unionByName(rest)


def touching(edges: DataFrame, entities: DataFrame, most: int) -> DataFrame:
    """(entity, ...): for each stated entity, its ``most`` most confident edges that are not replaced."""
    ends = edges.where(F.coalesce("status", F.lit("")) != "replaced").withColumn("entity", F.explode(F.array_distinct(F.array("subject", "object"))))
    mine = ends.join(entities.select("entity").distinct(), "entity", "left_semi")
    rank = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("confidence"), "subject", "predicate", "object"))
    return mine.withColumn("rank", rank).where(F.col("rank") <= most)


def triggered(hits: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """(candidate, score, queries): the k candidates of the best score that are not known, with the queries that found them, in order."""
    rows = hits.join(known.select("candidate").distinct(), "candidate", "left_anti")
    out = rows.groupBy("candidate").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("query")).alias("queries"))
    return out.orderBy(F.desc("score"), "candidate").limit(k)


def negatives(rows: DataFrame, most: int = 3) -> DataFrame:
    """(key, place, kind, chosen, rejected, hardness): the ``most`` hardest different negatives of each row.

    ``rows``: key, chosen, candidates as an array of (kind, text).  A candidate
    that equals what was chosen, or an earlier one, does not count.
    """
    flat = rows.select("key", "chosen", F.posexplode("candidates").alias("pos", "c")).select("key", "chosen", "pos", "c.kind", F.col("c.text").alias("rejected"))
    flat = flat.where(F.trim("rejected") != "").where("rejected <> chosen").withColumn("same", content_key("chosen", "rejected"))
    once = flat.groupBy("key", "same").agg(F.min_by(F.struct("kind", "chosen", "rejected", "pos"), "pos").alias("r")).select("key", "r.*")
    scored = once.withColumn("hardness", hardness(F.col("chosen"), F.col("rejected")))
    place = F.row_number().over(W.partitionBy("key").orderBy(F.desc("hardness"), "pos"))
    return scored.withColumn("place", place).where(F.col("place") <= most).select("key", "place", "kind", "chosen", "rejected", "hardness")
