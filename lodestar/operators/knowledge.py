"""Terms, co-occurrence edges and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions import text as T

#: Weights of the linear edge score: log count, PMI, trend, mean confidence, expert weight.
EDGE_WEIGHTS = (1.0, 0.75, 1.25, 0.5, 1.5)
#: Confidence of a co-occurrence.
COOCCURRENCE_CONFIDENCE = 0.4

# Strengths of predicates; others count DEFAULT_STRENGTH.
PREDICATE_STRENGTH = {
    "causes": 1.0, "leads_to": 0.95, "results_in": 0.90,
    "prevents": 0.90, "inhibits": 0.90, "drives": 0.90,
    "induces": 0.90, "triggers": 0.90, "promotes": 0.85,
    "improves": 0.85, "reduces": 0.85, "increases": 0.85,
    "decreases": 0.85, "outperforms": 0.85,
    "affects": 0.80, "influences": 0.80,
    "depends_on": 0.75, "requires": 0.75, "enables": 0.75,
    "assumes": 0.70,
    "predicts": 0.80, "precedes": 0.75, "follows": 0.75,
    "uses": 0.60, "used_for": 0.60, "applied_to": 0.60,
    "are_used_for": 0.60, "is_used_for": 0.60, "used_in": 0.60,
    "combined_with": 0.55, "compared_to": 0.55,
    "incorporates": 0.55, "leverages": 0.55, "captures": 0.55,
    "measures": 0.50, "reflects": 0.50, "manages": 0.50,
    "addresses": 0.50, "accounts_for": 0.50,
    "is_computed_from": 0.45, "is_determined_by": 0.45,
    "is_measured_by": 0.45, "arises_from": 0.45,
    "involves": 0.40, "allows": 0.40,
    "associated_with": 0.10, "related_to": 0.10,
    "contradicts": 0.70, "supports": 0.65, "extends": 0.60,
    "is_a": 0.20, "is_type_of": 0.20, "is_part_of": 0.25,
    "cooccurs_with": 0.05,
    "is_segmented_into": 0.05, "consists_of": 0.10,
    "was_destroyed_after_experiment": 0.0, "calculated_at": 0.05,
    "is_estimated_to": 0.05, "is_equal_to": 0.05,
    "acknowledges": 0.0, "thanks": 0.0,
}
DEFAULT_STRENGTH = 0.40
#: Weights and bias of the assertion scorer, in the order of :func:`assertion_features`.
SCORER_WEIGHTS = (1.5, 0.8, 1.2, 0.3, 1.0, 0.7, 1.0, 0.5, 0.6, 0.4)
SCORER_BIAS = -4.5


def papers_of(documents: DataFrame) -> DataFrame:
    """Documents as papers: paper_id, year 2015 to 2024 by the id, text."""
    return documents.select(F.col("doc_id").alias("paper_id"), (F.lit(2015) + F.col("doc_id") % 10).cast("int").alias("year"), "text")


def rake_terms(papers: DataFrame, most: int = 25, language: str = "en", boost: tuple[str, ...] = ()) -> DataFrame:
    """(paper_id, term, score, rank): key phrases by rapid automatic keyword extraction.

    A word scores (degree + frequency) / frequency, a phrase the sum of its
    words; ties go to the phrase seen first.  A phrase of ``boost`` scores a
    quarter more, and one that a paper only has inside other words joins it with
    0.8, after all others.  Phrases are dealt by paper once; every
    grouping and ranking after that is within a paper and keeps that
    partitioning, word scores being sums over windows in place of a join.
    """
    found = papers.select("paper_id", F.posexplode(T.phrases("text", language=language)).alias("pos", "words")).repartition("paper_id")
    firsts = found.groupBy("paper_id", F.array_join("words", " ").alias("term")).agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))
    parts = firsts.select("paper_id", "term", "first_pos", "n", F.split("term", " ").alias("words"))
    parts = parts.select("paper_id", "term", "first_pos", "n", (F.col("n") * (F.size("words") - 1)).alias("others"), F.explode("words").alias("word"))
    same = W.partitionBy("paper_id", "word")
    word_score = (F.sum("others").over(same) + F.sum("n").over(same)) / F.sum("n").over(same)
    scored = parts.select("paper_id", "term", "first_pos", word_score.alias("word_score")).groupBy("paper_id", "term", "first_pos").agg(F.sum("word_score").alias("raw"))
    scored = scored.withColumn("score", F.round(F.when(F.length("term") < 3, F.col("raw") * 0.5).otherwise(F.col("raw")), 6))
    if boost:
        named = F.array(*(F.lit(b.strip().lower()) for b in boost))
        scored = scored.withColumn("score", F.when(F.array_contains(named, F.col("term")), F.round(F.col("score") * 1.25, 6)).otherwise(F.col("score")))
        inside = papers.select("paper_id", F.posexplode(F.filter(named, lambda b: F.contains(F.lower("text"), b))).alias("place", "term")).distinct()
        new = inside.join(scored.select("paper_id", "term"), ["paper_id", "term"], "left_anti").select("paper_id", "term", (F.lit(1 << 30) + F.col("place")).alias("first_pos"), F.lit(0.8).alias("score"))
        scored = scored.select("paper_id", "term", "first_pos", "score").unionByName(new)
    rank = F.row_number().over(W.partitionBy("paper_id").orderBy(F.desc("score"), "first_pos"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("paper_id", "term", "score", "rank")


def cooccurrences(papers: DataFrame, terms: DataFrame) -> DataFrame:
    """(paper_id, year, source, target, n): sentences of a paper that contain both terms, source < target.

    A paper has at most as many terms as :func:`rake_terms` keeps, so its pairs
    are bounded; the join is on the paper.
    """
    own = terms.groupBy("paper_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    lines = papers.join(own, "paper_id").select("paper_id", "year", "terms", F.explode(T.sentences("text")).alias("sentence"))
    inside = lines.select("paper_id", "year", F.filter("terms", lambda t: F.contains(F.col("sentence"), t)).alias("inside"))
    pairs = F.flatten(F.transform("inside", lambda a, i: F.transform(F.slice("inside", i + 2, F.size("inside")), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    pairs = inside.where(F.size("inside") > 1).select("paper_id", "year", F.explode(pairs).alias("p"))
    return pairs.groupBy("paper_id", "year", F.col("p.source").alias("source"), F.col("p.target").alias("target")).agg(F.count(F.lit(1)).alias("n"))


def edges_of(found: DataFrame) -> DataFrame:
    """(source, target, total_count, papers): one row per edge; ``found`` has one row per paper and pair."""
    return found.groupBy("source", "target").agg(F.sum("n").alias("total_count"), F.count(F.lit(1)).alias("papers"))


def yearly(found: DataFrame) -> DataFrame:
    return found.groupBy("source", "target", "year").agg(F.sum("n").alias("n"))


def node_frequency(terms: DataFrame) -> DataFrame:
    """(term, doc_freq): papers per term; ``terms`` has one row per paper and term."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))


def scored_edges(found: DataFrame, terms: DataFrame, recent: int = 3) -> DataFrame:
    """Edges with pmi, trend, log_count and the linear score.

    The numbers of the corpus (papers, years, latest year) are one row.
    ``found`` has one row per paper and pair, ``terms`` one per paper and term,
    so papers are counted without a second grouping.
    """
    papers = terms.agg(F.greatest(F.lit(1), F.countDistinct("paper_id")).alias("n_docs"))
    years = found.agg(F.max("year").alias("max_year"), F.countDistinct("year").alias("n_years"))
    late = found.crossJoin(F.broadcast(years)).groupBy("source", "target").agg(
        F.sum("n").alias("total_count"),
        F.count(F.lit(1)).alias("papers"),
        F.sum(F.when(F.col("year") > F.col("max_year") - recent, F.col("n")).otherwise(0)).alias("recent"),
        F.max("n_years").alias("n_years"),
    )
    freq = node_frequency(terms)
    out = late.join(freq.select(F.col("term").alias("source"), F.col("doc_freq").alias("du")), "source").join(freq.select(F.col("term").alias("target"), F.col("doc_freq").alias("dv")), "target").crossJoin(F.broadcast(papers))
    pmi = F.log(F.col("papers") * F.col("n_docs") / (F.col("du") * F.col("dv")) + 1e-9)
    trend = F.col("recent") / F.greatest(F.col("total_count"), F.lit(1)) - F.lit(float(recent)) / F.greatest(F.col("n_years"), F.lit(1))
    out = out.withColumns({"pmi": pmi, "trend": trend, "log_count": F.log1p("total_count"), "mean_conf": F.lit(COOCCURRENCE_CONFIDENCE)})
    return out.withColumn("score", linear_score(F.col("log_count"), F.col("pmi"), F.col("trend"), F.col("mean_conf"), F.lit(0.0)))


def linear_score(*parts: Column) -> Column:
    total = F.lit(0.0)
    for weight, part in zip(EDGE_WEIGHTS, parts, strict=True):
        total = total + weight * part
    return total


def strength(predicate: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in PREDICATE_STRENGTH.items() for x in pair))
    return F.coalesce(F.element_at(table, F.lower(F.trim(predicate))), F.lit(DEFAULT_STRENGTH))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def assertion_scores(edges: DataFrame, weights: tuple = SCORER_WEIGHTS, bias: float = SCORER_BIAS) -> DataFrame:
    """Edges with ten features f0 to f9 and the logistic quality score.

    ``edges``: source, target, predicate, total_count, papers, n_docs, du, dv,
    mean_conf, pmi, evidence_overlap, evidence_count, polarity_clarity.
    """
    degree = edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
    most = edges.agg(F.max("total_count").alias("max_tc"), F.max(F.greatest("du", "dv")).alias("max_df"), F.max("evidence_count").alias("max_ec"))
    out = edges.join(degree.select(F.col("node").alias("source"), F.col("deg").alias("deg_s")), "source").join(degree.select(F.col("node").alias("target"), F.col("deg").alias("deg_t")), "target").crossJoin(F.broadcast(most))
    log_max = F.log1p("max_df")
    features = [
        F.log1p("total_count") / F.log1p("max_tc"),
        F.when(log_max > 0, ((1 - F.log1p("du") / log_max) + (1 - F.log1p("dv") / log_max)) / 2).otherwise(0.5),
        strength(F.col("predicate")),
        F.least(F.greatest("mean_conf", F.lit(0.0)), F.lit(1.0)),
        F.col("evidence_overlap"),
        F.log1p("evidence_count") / F.log1p("max_ec"),
        F.col("papers") / F.col("n_docs"),
        F.col("polarity_clarity"),
        F.when((F.col("deg_s") > 1) & (F.col("deg_t") > 1), 1.0).when((F.col("deg_s") > 1) | (F.col("deg_t") > 1), 0.5).otherwise(0.0),
        sigmoid(F.col("pmi")),
    ]
    out = out.withColumns({f"f{k}": f for k, f in enumerate(features)})
    margin = F.lit(bias)
    for k, w in enumerate(weights):
        margin = margin + w * F.col(f"f{k}")
    return out.withColumn("quality_score", sigmoid(margin))


def triplet_edges(triplets: DataFrame) -> DataFrame:
    """One row per (subject, predicate, object): counts, confidence, polarity, papers, evidence and intervals.

    ``triplets``: paper_id, seq, subject, predicate, object, confidence,
    polarity, year, start, end, granularity, time_source, quote.  Names and
    predicates are normalised.  A triplet without a year gives no edge; its
    terms still count as nodes (:func:`triplet_terms`).

    Years and polarities are counted before they are gathered, so that only
    different ones of a hot edge reach its row.
    """
    keys = ["subject", "predicate", "object"]
    own = triplets.where(F.col("year").isNotNull()).withColumns({k: T.norm(k) for k in keys})
    yearly = own.groupBy(*keys, "year").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n").alias("total_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "n")))).alias("yearly_count"))
    sums = own.groupBy(*keys).agg(F.avg("confidence").alias("mean_confidence"), *(F.count_if(F.coalesce("polarity", F.lit("unknown")) == p).alias(p) for p in ("supports", "contradicts", "unknown")), F.count_if(F.trim("quote") != "").alias("evidence_count"))
    papers = own.select(*keys, "paper_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("papers"), F.min("paper_id").alias("first_paper"))
    return yearly.join(sums, keys).join(papers, keys).withColumn("mean_confidence", F.coalesce("mean_confidence", F.lit(0.0)))


def triplet_terms(triplets: DataFrame) -> DataFrame:
    """(paper_id, term): the different ends of a paper's triplets."""
    return triplets.select("paper_id", F.explode(F.array(T.norm("subject"), T.norm("object"))).alias("term")).where("term <> ''").distinct()


def scored_triplet_edges(edges: DataFrame, terms: DataFrame, recent: int = 3) -> DataFrame:
    """Edges of :func:`triplet_edges` with pmi, trend, log_count and the linear score, as :func:`scored_edges` gives co-occurrences."""
    corpus = terms.agg(F.greatest(F.lit(1), F.countDistinct("paper_id")).alias("n_docs"))
    years = edges.select(F.explode(F.map_keys("yearly_count")).alias("y")).agg(F.max("y").alias("max_year"), F.greatest(F.countDistinct("y"), F.lit(1)).alias("n_years"))
    freq = node_frequency(terms)
    out = edges.join(freq.select(F.col("term").alias("subject"), F.col("doc_freq").alias("du")), "subject").join(freq.select(F.col("term").alias("object"), F.col("doc_freq").alias("dv")), "object").crossJoin(F.broadcast(corpus)).crossJoin(F.broadcast(years))
    late = F.aggregate(F.map_entries("yearly_count"), F.lit(0).cast("long"), lambda n, e: n + F.when(e["key"] > F.col("max_year") - recent, e["value"]).otherwise(0))
    pmi = F.log(F.col("papers") * F.col("n_docs") / (F.col("du") * F.col("dv")) + 1e-9)
    trend = late / F.greatest("total_count", F.lit(1)) - F.lit(float(recent)) / F.col("n_years")
    out = out.withColumns({"pmi": pmi, "trend": trend, "log_count": F.log1p("total_count")}).drop("n_docs", "max_year", "n_years")
    return out.withColumn("score", linear_score(F.col("log_count"), F.col("pmi"), F.col("trend"), F.col("mean_confidence"), F.lit(0.0)))


def anchored(triplets: DataFrame, lift: float = 0.15) -> DataFrame:
    """Triplets of a paper's summary with their confidence lifted, 1 at most."""
    return triplets.withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + lift))


def first_chunks(chunks: DataFrame, most: int = 16) -> DataFrame:
    """The first ``most`` chunks (paper_id, pos) of each paper, those that triplets are drawn from."""
    return chunks.withColumn("__k", F.row_number().over(W.partitionBy("paper_id").orderBy("pos"))).where(F.col("__k") <= most).drop("__k")


def event_rows(edges: DataFrame) -> DataFrame:
    """(subject, predicate, object, year, copy, weight, confidence, polarity, paper_id): each edge and year as many times as it was counted, weighing its count.

    The polarity is the commonest, supports first; a confidence of 0 counts 0.6;
    the paper is the first of the edge.
    """
    polarity = F.when((F.col("supports") >= F.col("contradicts")) & (F.col("supports") >= F.col("unknown")), "supports").when(F.col("contradicts") >= F.col("unknown"), "contradicts").otherwise("unknown")
    confidence = F.when(F.col("mean_confidence") == 0, 0.6).otherwise(F.col("mean_confidence"))
    years = edges.select("subject", "predicate", "object", confidence.alias("confidence"), polarity.alias("polarity"), F.col("first_paper").alias("paper_id"), F.explode(F.map_entries("yearly_count")).alias("y"))
    return years.select("subject", "predicate", "object", F.col("y.key").alias("year"), F.explode(F.sequence(F.lit(1), F.col("y.value").cast("int"))).alias("copy"), F.col("y.value").cast("double").alias("weight"), "confidence", "polarity", "paper_id")
