"""Queries that filter, triage and evaluate triplets and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import evaluation as V
from lodestar.operators import events as E
from lodestar.operators import filters as Q
from lodestar.plans.event_queries import EDGES_SQL, TRIPLETS_SQL
from lodestar.plans.registry import query, table


def _triplets(spark, sf_dir):
    return E.triplets(table(spark, sf_dir, "events"))


@query("exclusion_spec", "SELECT p_partkey, (p_size > 45 OR p_brand IN ('Brand#13', 'Brand#22') OR contains(lower(p_type), 'promo')) AS excluded FROM part")
def exclusion_spec(spark, sf_dir):
    """Parts as papers: brand as identifier, type as title, 1990 + size as year."""
    rules = Q.exclusion_rules({"exclusions": {"dois": ["Brand#13", "brand#22"], "contains": "PROMO", "years": {"max": 2035}}})
    parts = table(spark, sf_dir, "part")
    out = Q.excluded(rules, F.array("p_brand"), F.array("p_type"), F.array().cast("array<string>"), F.col("p_size") + 1990)
    return parts.select("p_partkey", out.alias("excluded"))


@query("relation_families", "SELECT predicate, CASE WHEN regexp_matches(predicate, 'co-?occur') THEN 'cooccurrence' WHEN regexp_matches(predicate, 'caus|lead|result|induce|trigger|drive|prevent|inhibit|promote|depend') THEN 'causal' WHEN regexp_matches(predicate, 'improve|reduce|increase|decrease|outperform|compare') THEN 'comparative' WHEN regexp_matches(predicate, 'precede|follow|before|after|during') THEN 'temporal' WHEN regexp_matches(predicate, 'is_a|type_of|part_of|consist') THEN 'taxonomic' ELSE 'other' END AS family, count(*) AS n FROM (SELECT CASE p_size % 7 WHEN 0 THEN 'causes' WHEN 1 THEN 'related_to' WHEN 2 THEN 'improves' WHEN 3 THEN 'precedes' WHEN 4 THEN 'is_a' WHEN 5 THEN 'cooccurs_with' ELSE 'mentions' END AS predicate FROM part) GROUP BY 1, 2")
def relation_families(spark, sf_dir):
    names = ["causes", "related_to", "improves", "precedes", "is_a", "cooccurs_with", "mentions"]
    predicate = F.element_at(F.array(*map(F.lit, names)), (F.col("p_size") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(predicate.alias("predicate")).groupBy("predicate", Q.family(F.col("predicate")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("triage_of_parts", """WITH t AS (SELECT p_partkey, lower(p_brand) AS s, CASE p_size % 3 WHEN 0 THEN 'causes' WHEN 1 THEN 'thanks' ELSE 'mentions' END AS p, lower(p_type) AS o, p_retailprice / 2000 AS q FROM part),
g AS (SELECT p_partkey, CASE WHEN p = 'thanks' THEN -3.0 ELSE 0.0 END + CASE WHEN p = 'causes' THEN 2.0 ELSE 0.0 END + CASE WHEN q >= 0.7 THEN 2.5 WHEN q >= 0.4 THEN 1.0 WHEN q >= 0 AND q < 0.2 THEN -2.0 ELSE 0.0 END AS score FROM t)
SELECT p_partkey, score, CASE WHEN score >= 2 THEN 'accept' WHEN score <= -2 THEN 'reject' ELSE 'review' END AS verdict FROM g""")
def triage_of_parts(spark, sf_dir):
    predicate = F.when(F.col("p_size") % 3 == 0, "causes").when(F.col("p_size") % 3 == 1, "thanks").otherwise("mentions")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("subject"), predicate.alias("predicate"), F.col("p_type").alias("object"), F.lit("").alias("snippet"), F.lit(0.0).alias("importance"), F.lit(1).alias("papers"), (F.col("p_retailprice") / 2000).alias("quality"))
    return Q.triage(rows).select("p_partkey", F.col("triage_score").alias("score"), "verdict")


@query("collapsed_pairs", f"""WITH {EDGES_SQL}, r AS (SELECT *, CASE predicate WHEN 'view' THEN 0 ELSE total_count END AS w FROM edges WHERE total_count >= 1) SELECT least(subject, object) AS a, greatest(subject, object) AS b, max(CASE WHEN w = 0 THEN 1.0 ELSE w END) AS weight, arg_min(predicate, (-total_count, predicate)) AS predicate FROM r GROUP BY 1, 2""")
def collapsed_pairs(spark, sf_dir):
    edges = E.edge_counts(_triplets(spark, sf_dir)).select(F.col("subject").alias("source"), F.col("object").alias("target"), "predicate", "total_count", F.when(F.col("predicate") == "view", 0.0).otherwise(F.col("total_count").cast("double")).alias("weight"), F.struct(-F.col("total_count"), "predicate").alias("edge_rank"))
    return Q.collapsed(edges)


@query("target_coverage", "SELECT lang, count(*) AS n, count(quality) AS ready, count(quality) AS with_quality, count(toxic) AS with_toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def target_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return Q.target_coverage(rows, "lang", ["quality", "toxic"])


@query("triplet_scores_by_day", f"""WITH {TRIPLETS_SQL}, p AS (SELECT subject AS c, lower(predicate) || '|' || object AS k, count(*) AS n FROM triplets WHERE value >= 50 GROUP BY 1, 2), g AS (SELECT DISTINCT subject AS c, lower(predicate) || '|' || object AS k FROM triplets WHERE value < 50),
s AS (SELECT coalesce(p.c, g.c) AS c, count(g.k) AS n_gold, coalesce(sum(n), 0) AS n_pred, coalesce(sum(CASE WHEN g.k IS NOT NULL THEN n END), 0) AS m FROM p FULL JOIN g ON p.c = g.c AND p.k = g.k GROUP BY 1)
SELECT c AS subject_case, n_gold, n_pred, round(m / greatest(n_pred, 1), 6) AS precision, round(m / greatest(n_gold, 1), 6) AS recall, round(CASE WHEN m > 0 THEN 2 * (m / greatest(n_pred, 1)) * (m / greatest(n_gold, 1)) / (m / greatest(n_pred, 1) + m / greatest(n_gold, 1)) ELSE 0 END, 6) AS f1 FROM s""")
def triplet_scores_by_day(spark, sf_dir):
    """A user's events of high value as predictions of those of low value."""
    rows = _triplets(spark, sf_dir).withColumn("subject_case", F.col("subject"))
    out = V.by_case(rows.where("value >= 50"), rows.where("value < 50"), "subject_case")
    return out.select("subject_case", "n_gold", "n_pred", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("corpus_scores", f"""WITH {TRIPLETS_SQL}, p AS (SELECT DISTINCT subject, predicate, object FROM triplets WHERE value >= 50), g AS (SELECT DISTINCT subject, predicate, object FROM triplets WHERE value < 50), m AS (SELECT count(*) AS m FROM p JOIN g USING (subject, predicate, object))
SELECT (SELECT count(*) FROM p) AS n_pred, (SELECT count(*) FROM g) AS n_gold, m AS matched, round(m / (SELECT count(*) FROM p), 6) AS precision, round(m / (SELECT count(*) FROM g), 6) AS recall, round(2 * m / ((SELECT count(*) FROM p) + (SELECT count(*) FROM g)), 6) AS f1 FROM m""")
def corpus_scores(spark, sf_dir):
    rows = _triplets(spark, sf_dir)
    out = V.corpus(rows.where("value >= 50"), rows.where("value < 50"))
    return out.select("n_pred", "n_gold", "matched", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("paired_reviews", """WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS va FROM events WHERE value < 40 GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, event_id) AS vb FROM events WHERE value >= 60 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, va AS verdict_a, vb AS verdict_b, CASE WHEN va IS NULL THEN 'only_b' WHEN vb IS NULL THEN 'only_a' WHEN va = vb THEN 'same' ELSE 'differs' END AS status FROM a FULL JOIN b ON a.user_id = b.user_id""")
def paired_reviews(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("verdict"), "value")
    return V.paired(rows.where("value < 40"), rows.where("value >= 60"), "user_id", "event_id")


@query("data_gates", """WITH m AS (SELECT count(*) AS n, avg(toxic) AS toxic_share FROM labels) SELECT 'n' AS gate, CAST(n AS DOUBLE) AS value, CAST(100 AS DOUBLE) AS bound, n >= 100 AS passed FROM m UNION ALL SELECT 'toxic_share', round(toxic_share, 6), CAST(0.5 AS DOUBLE), toxic_share <= 0.5 FROM m""")
def data_gates(spark, sf_dir):
    metrics = table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("toxic_share"))
    return V.gates(metrics, {"n": (">=", 100), "toxic_share": ("<=", 0.5)}).withColumn("value", F.round("value", 6))


@query("sources_without_labels", "SELECT source, count(l.doc_id) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source")
def sources_without_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return V.without_output(docs, docs.join(table(spark, sf_dir, "labels"), "doc_id"), "source")


# Edges as texts with what must become of them: in every mode, and if weak.
EDGE_TEXTS = (
    ("cooccurs_with", "alpha", True, True),
    ("related_to", "alpha", False, False),
    ("associated_with", "alpha", False, False),
    ("co-occurs", "alpha causes beta", True, False),
    ("causes", "text:cooccurrence", True, False),
    ("mentions", "it triggers", False, False),
)
EDGE_TEXTS_SQL = ", ".join(f"({k}, {a}, {w})" for k, (_, _, a, w) in enumerate(EDGE_TEXTS))


@query("hidden_edges", f"SELECT p_partkey, any_mode AS excluded, if_weak AND round(p_size / 50, 6) <= 0.45 AS hidden FROM part JOIN (VALUES {EDGE_TEXTS_SQL}) v(k, any_mode, if_weak) ON p_partkey % 6 = k")
def hidden_edges(spark, sf_dir):
    """Co-occurrences by any text of the edge; weak ones stay if a text is causal; the strength is the first field within 0 and 1."""
    pick = lambda n: F.element_at(F.array(*(F.lit(e[n]) for e in EDGE_TEXTS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    texts = [pick(0), pick(1)]
    strength = Q.strength_of(F.lit(7.5), F.lit(None).cast("double"), F.col("p_size") / 50, F.lit(0.1))
    return table(spark, sf_dir, "part").select("p_partkey", Q.hidden(texts, strength, "exclude_all").alias("excluded"), Q.hidden(texts, strength, "hide_weak").alias("hidden"))
