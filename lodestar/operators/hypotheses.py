"""Candidates, their ranking and their evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.operators.tables import staged
from lodestar.operators.training import contains_term

# Weights of the final score (candidate, prediction, multimodal, retrieval, reward).
FINAL_WEIGHTS = (1.6, 0.9, 0.7, 0.6, 1.0)
MIN_COUNT, MIN_TREND = 2, 0.05


def candidates(edges: DataFrame, k: int) -> DataFrame:
    """The k best emerging edges (count and trend above their bounds); only if there are none, the k strongest of all.

    Both branches end in a top-k, so at most 2 k rows meet.
    """
    order = [F.desc("score"), "source", "target"]
    columns = ("source", "target", "score", "trend")
    emerging = edges.where((F.col("total_count") >= MIN_COUNT) & (F.col("trend") > MIN_TREND)).orderBy(*order).limit(k).select(*columns, F.lit("emerging_edge").alias("kind"))
    none = emerging.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(1).alias("__none"))
    top = edges.orderBy(*order).limit(k).select(*columns, F.lit("top_edge").alias("kind"))
    return emerging.unionByName(top.crossJoin(F.broadcast(none)).drop("__none"))


def missing_links(edges: DataFrame, k: int, top: int = 400) -> DataFrame:
    """(source, target, score): the k pairs that share most neighbours among the ``top`` best edges and are not linked there.

    A hub has at most ``top`` neighbours in this, so its pairs are bounded.
    """
    best = edges.where("source <> target").orderBy(F.desc("score"), "source", "target").limit(top).select("source", "target")
    ways = staged(best.union(best.select("target", "source")).toDF("a", "b").distinct(), "best-links")
    pairs = ways.select("b", F.col("a").alias("source")).join(ways.select("b", F.col("a").alias("target")), "b").where("source < target").groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("score"))
    new = pairs.join(ways.select(F.col("a").alias("source"), F.col("b").alias("target")), ["source", "target"], "left_anti")
    return new.orderBy(F.desc("score"), "source", "target").limit(k)


def snippet(text: Column, a: Column, b: Column, most: int = 220) -> Column:
    """The first sentence that has both terms, else the text around the first of them, cut to ``most`` letters."""
    low = F.lower(text)
    has = F.filter(F.split(F.regexp_replace(text, "\n", " "), r"\."), lambda s: F.contains(F.lower(s), F.lower(a)) & F.contains(F.lower(s), F.lower(b)))
    found = F.get(has, F.lit(0))
    place = lambda x: F.position(F.lower(x), low)
    at = F.when(place(a) > 0, place(a)).otherwise(place(b))
    start = F.greatest(F.lit(1), at - 80)
    around = F.when(at > 0, F.trim(text.substr(start, at + 140 - start))).otherwise(text)
    cut = lambda x: F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)
    return F.when(found.isNotNull(), cut(F.trim(found))).otherwise(cut(around))


def term_evidence(pairs: DataFrame, papers: DataFrame, most: int = 3) -> DataFrame:
    """(source, target, place, paper_id, snippet): of each of a bounded number of pairs, the first ``most`` papers that mention both.

    A top-k of pairs meets every paper: the caller bounds it.
    """
    own = pairs.select("source", "target")
    both = papers.crossJoin(F.broadcast(own)).where(F.contains(F.lower("text"), F.lower("source")) & F.contains(F.lower("text"), F.lower("target")))
    place = F.row_number().over(W.partitionBy("source", "target").orderBy("paper_id"))
    return both.withColumn("place", place).where(F.col("place") <= most).select("source", "target", "place", "paper_id", snippet(F.col("text"), F.col("source"), F.col("target")).alias("snippet"))


def all_candidates(edges: DataFrame, links: DataFrame, predicted: DataFrame, agent: DataFrame, k: int) -> DataFrame:
    """(source, target, predicate, score, kind): the k best of emerging edges, missing links, temporal predictions (times ten) and the agent's candidates.

    An agent's candidate that repeats another is left out; those of equal score
    come in this order.  All four are top-k lists.
    """
    edge_part = edges.select("source", "target", F.lit("cooccurs_with").alias("predicate"), "score", "kind", F.lit(0).alias("branch"))
    link_part = links.select("source", "target", F.lit("may_relate_to").alias("predicate"), "score", F.lit("missing_link").alias("kind"), F.lit(1).alias("branch"))
    time_part = predicted.select("source", "target", F.lit("may_relate_to").alias("predicate"), (F.col("score") * 10).alias("score"), F.lit("tgnn_missing_link").alias("kind"), F.lit(2).alias("branch"))
    out = edge_part.unionByName(link_part).unionByName(time_part)
    new = agent.select("source", "target", F.lit("may_relate_to").alias("predicate"), "score", F.concat(F.lit("agent_"), F.col("kind")).alias("kind"), F.lit(3).alias("branch")).join(out.select("source", "target", "predicate"), ["source", "target", "predicate"], "left_anti")
    return out.unionByName(new).orderBy(F.desc("score"), "branch", "source", "target").limit(k).drop("branch")


# What the rank of both ends adds to a candidate of each kind.
BOOSTS = {"cross_bridge": 0.25, "link_prediction": 0.1, "central_emergence": 0.15}


def agent_candidates(bridges: DataFrame, predicted: DataFrame, spectral: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """(source, target, score, kind): the k best pairs of three lists of (u, v, score), lifted by the ranks of their ends.

    A pair counts once in either direction, in the first list that has it.
    ``ranks``: node, rank of the leading nodes; others add nothing.
    """
    rows = None
    for priority, ((kind, _), part) in enumerate(zip(BOOSTS.items(), (bridges, predicted, spectral), strict=True)):
        own = part.select("u", "v", "score", F.lit(kind).alias("kind"), F.lit(priority).alias("priority"))
        rows = own if rows is None else rows.unionByName(own)
    once = rows.where("u <> v").groupBy(F.least("u", "v").alias("source"), F.greatest("u", "v").alias("target")).agg(F.min_by(F.struct("score", "kind"), F.struct("priority", -F.col("score"))).alias("r"))
    out = once.select("source", "target", "r.score", "r.kind")
    for end in ("source", "target"):
        out = out.join(ranks.select(F.col("node").alias(end), F.col("rank").alias(f"rank_{end}")), end, "left")
    lift = F.coalesce("rank_source", F.lit(0.0)) + F.coalesce("rank_target", F.lit(0.0))
    boost = F.lit(0.0)
    for kind, weight in BOOSTS.items():
        boost = F.when(F.col("kind") == kind, weight).otherwise(boost)
    return out.select("source", "target", (F.col("score") + boost * lift).alias("score"), "kind").orderBy(F.desc("score"), "source", "target").limit(k)


def matched_predictions(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Candidates with prediction, the score of the first prediction of the same two ends in either direction, null without one."""
    pair = lambda a, b: [F.least(a, b).alias("__a"), F.greatest(a, b).alias("__b")]
    first = predictions.groupBy(*pair("source", "target")).agg(F.min_by("score", "pos").alias("prediction"))
    return rows.select("*", *pair("source", "target")).join(first, ["__a", "__b"], "left").drop("__a", "__b")


def with_edges(rows: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("source", "target", "predicate")) -> DataFrame:
    """Candidates with first_seen, last_seen and ordering of the edge that is exactly theirs; predicted_or_missing without one.

    ``edges``: the keys and yearly_count, a map by year.
    """
    found = edges.select(*keys, F.array_sort(F.map_entries("yearly_count")).alias("years"))
    joined = rows.join(found, list(keys), "left")
    first, last = F.get("years", F.lit(0)), F.get("years", F.size("years") - 1)
    change = F.when(F.size("years") < 2, "stable").when(last["value"] > first["value"], "strengthening").when(last["value"] < first["value"], "weakening").otherwise("persistent")
    ordering = F.when(F.col("kind").endswith("missing_link"), "predicted_missing_link").when(F.col("years").isNull(), "predicted_or_missing").otherwise(change)
    return joined.withColumns({"first_seen": first["key"], "last_seen": last["key"], "ordering": ordering}).drop("years")


def matched_triplets(rows: DataFrame, triplets: DataFrame, most: int = 6) -> DataFrame:
    """(key, place, pos): of each of a bounded number of candidates, the first ``most`` triplets whose terms contain its own or lie in them.

    Source and target as subject and object or the other way round, or source
    and predicate as they are.  ``rows``: key, source, target, predicate, a
    top-k; ``triplets``: pos, subject, predicate, object.
    """
    own = rows.select("key", "source", "target", F.col("predicate").alias("wanted"))
    s, t = F.col("source"), F.col("target")
    hit = (contains_term(s, F.col("subject")) & contains_term(t, F.col("object"))) | (contains_term(s, F.col("object")) & contains_term(t, F.col("subject"))) | (contains_term(s, F.col("subject")) & contains_term(F.col("wanted"), F.col("predicate")))
    place = F.row_number().over(W.partitionBy("key").orderBy("pos"))
    return triplets.crossJoin(F.broadcast(own)).where(hit).withColumn("place", place).where(F.col("place") <= most).select("key", "place", "pos")


def drafted(rows: DataFrame) -> DataFrame:
    """Template drafts: title and a confidence of round(5 + 10 trend), held within 3 to 9."""
    confidence = F.least(F.greatest(F.bround(5 + 10 * F.col("trend")), F.lit(3.0)), F.lit(9.0)).cast("int")
    return rows.withColumn("title", F.format_string("%s may shape %s", "source", "target")).withColumn("confidence", confidence)


def final_score(*parts):
    return reduce(lambda a, b: a + b, [w * p for w, p in zip(FINAL_WEIGHTS, parts, strict=True)])


def reward(has_time, n_evidence, expert):
    """-1 without a time, -1 without evidence, 0.1 per piece of evidence up to 0.5, and the expert weight."""
    return F.when(has_time, 0.0).otherwise(-1.0) + F.when(n_evidence > 0, 0.0).otherwise(-1.0) + F.least(F.lit(0.5), 0.1 * n_evidence) + expert


def citations(rows: DataFrame, key: str, most: int = 6, letters: int = 220) -> DataFrame:
    """(key, place, source_id, snippet): the first ``most`` different citations by source priority and position.

    Two are the same if source and uncut snippet are; what is given out is cut.
    """
    once = rows.groupBy(key, "source_id", "snippet").agg(F.min(F.struct("priority", "pos")).alias("at"))
    placed = once.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("at", "source_id"))).where(F.col("place") <= most)
    return placed.select(key, "place", "source_id", F.substring("snippet", 1, letters).alias("snippet"))


def ranked_records(rows: DataFrame, neighbours: DataFrame, matches: DataFrame, analyses: DataFrame, evidence: DataFrame, overrides: DataFrame, k: int) -> DataFrame:
    """The k candidates of the best final score, with its parts.

    ``rows``: key, score, prediction (null without one), time_scope.
    ``neighbours``: key, rank, strength; the mean of the first six counts.
    ``matches`` and ``analyses``: key, a row per matched triplet and per look at
    a picture; 0.2 and 0.15 each, 1 at most.  ``evidence``: key, place,
    source_id; ``overrides``: source_id, pos, weight, the last of one id counts,
    for the first ten citations whose id has a bar.
    """
    near = neighbours.where("rank <= 6").groupBy("key").agg(F.avg("strength").alias("retrieval"))
    seen = matches.groupBy("key").agg(F.count(F.lit(1)).alias("n_matches")).join(analyses.groupBy("key").agg(F.count(F.lit(1)).alias("n_looks")), "key", "full_outer")
    weights = overrides.groupBy("source_id").agg(F.max_by("weight", "pos").alias("weight"))
    cited = evidence.join(weights, "source_id", "left")
    counted = (F.col("place") <= 10) & F.contains(F.col("source_id"), F.lit("|"))
    backed = cited.groupBy("key").agg(F.count(F.lit(1)).alias("n_evidence"), F.sum(F.when(counted, F.col("weight"))).alias("expert"))
    out = rows.join(near, "key", "left").join(seen, "key", "left").join(backed, "key", "left").na.fill(0.0, ["retrieval", "prediction", "expert"]).na.fill(0, ["n_matches", "n_looks", "n_evidence"])
    multimodal = F.least(F.lit(1.0), 0.2 * F.col("n_matches") + 0.15 * F.col("n_looks"))
    has_time = F.coalesce(F.trim("time_scope") != "", F.lit(False))
    out = out.withColumns({"multimodal": multimodal, "reward": reward(has_time, F.col("n_evidence"), F.col("expert"))})
    total = final_score(F.col("score"), F.col("prediction"), F.col("multimodal"), F.col("retrieval"), F.col("reward"))
    return out.withColumn("final_score", total).orderBy(F.desc("final_score"), "key").limit(k).select("key", "score", "prediction", "multimodal", "retrieval", "reward", "final_score")


def first_answer(*predictions: DataFrame) -> DataFrame:
    """The first of several prediction tables that has a row, with backend, its place: what a chain of fallbacks gives."""
    for place, rows in enumerate(predictions):
        if not rows.isEmpty():
            return rows.withColumn("backend", F.lit(place))
    return predictions[-1].withColumn("backend", F.lit(len(predictions) - 1))
