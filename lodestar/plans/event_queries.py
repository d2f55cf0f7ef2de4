"""Queries over events as a temporal graph of users and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import keys as K
from lodestar.functions import text as T
from lodestar.operators import events as E
from lodestar.operators import knowledge as G
from lodestar.operators import filters as Q
from lodestar.operators import links as L
from lodestar.operators import reviews as R
from lodestar.plans.registry import query, table

TRIPLETS_SQL = "triplets AS (SELECT event_id, 'u' || user_id AS subject, event_type AS predicate, 'k' || json_extract_string(props, '$.k') AS object, ts, strftime(ts, '%Y-%m-%d') AS day, value FROM events)"
EDGES_SQL = TRIPLETS_SQL + ", edges AS (SELECT subject, predicate, object, count(*) AS total_count, count(DISTINCT day) AS active_days, min(day) AS first_day, max(day) AS last_day, avg(value) AS mean_value FROM triplets GROUP BY ALL)"


def _triplets(spark, sf_dir):
    return E.triplets(table(spark, sf_dir, "events"))


def _edges(spark, sf_dir):
    return E.edge_counts(_triplets(spark, sf_dir))


@query("event_stats", f"WITH {TRIPLETS_SQL} SELECT count(*) AS n_events, (SELECT count(DISTINCT n) FROM (SELECT subject AS n FROM triplets UNION ALL SELECT object FROM triplets)) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT subject, predicate, object FROM triplets)) AS n_edges FROM triplets")
def event_stats(spark, sf_dir):
    rows = _triplets(spark, sf_dir)
    nodes = rows.select(F.explode(F.array("subject", "object")).alias("n")).agg(F.countDistinct("n").alias("n_nodes"))
    return rows.agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("subject", "predicate", "object").alias("n_edges")).crossJoin(nodes)


@query("event_edges", f"WITH {EDGES_SQL} SELECT subject, predicate, object, total_count, active_days, first_day, last_day, round(mean_value, 6) AS mean_value FROM edges")
def event_edges(spark, sf_dir):
    return _edges(spark, sf_dir).withColumn("mean_value", F.round("mean_value", 6))


@query("event_stream_copies", f"WITH {TRIPLETS_SQL}, d AS (SELECT subject, predicate, object, day, count(*) AS n FROM triplets GROUP BY ALL) SELECT subject, object, sum(CAST(n AS DOUBLE) * n) AS strength, sum(n) AS copies FROM d GROUP BY subject, object")
def event_stream_copies(spark, sf_dir):
    days = _triplets(spark, sf_dir).groupBy("subject", "predicate", "object", "day").agg(F.count(F.lit(1)).alias("n"))
    return E.event_copies(days).groupBy("subject", "object").agg(F.sum("weight").alias("strength"), F.count(F.lit(1)).alias("copies"))


@query("chronological_split", f"WITH {TRIPLETS_SQL}, r AS (SELECT event_id, row_number() OVER (ORDER BY day, subject, object, event_id) AS rn, count(*) OVER () AS n FROM triplets) SELECT event_id, CASE WHEN rn <= greatest(1, floor(n * 0.7)) THEN 'train' WHEN rn <= greatest(greatest(1, floor(n * 0.7)), floor(n * 0.85)) THEN 'valid' ELSE 'test' END AS split FROM r")
def chronological_split(spark, sf_dir):
    rows = _triplets(spark, sf_dir).select("event_id", "day", "subject", "object")
    return E.chronological_split(rows, ["day", "subject", "object", "event_id"]).select("event_id", "split")


@query("temporal_link_prediction", """WITH e AS MATERIALIZED (SELECT l_partkey AS subject, -l_suppkey - 1 AS object, datediff('day', TIMESTAMP '1992-01-01', l_shipdate) // 365 AS t FROM lineitem),
w AS (SELECT subject AS a, object AS b, t FROM e UNION ALL SELECT object, subject, t FROM e), now AS (SELECT max(t) AS now FROM e), last AS MATERIALIZED (SELECT a, b, max(t) AS t FROM w GROUP BY a, b),
node AS MATERIALIZED (SELECT a, sum(CASE WHEN now - t <= 0 THEN 1.0 ELSE exp(-0.6931471805599453 * (now - t) / 2.0) END) AS memory, sum(CASE WHEN t >= now - 2 THEN 1.0 ELSE 0.0 END) AS recent, (SELECT 0.6 * count(*) FROM w WHERE w.a = last.a) AS strength FROM last, now GROUP BY a),
f AS (SELECT x.a AS u, y.a AS v, count(*) AS common, sum(CASE WHEN now - greatest(x.t, y.t) <= 0 THEN 1.0 ELSE exp(-0.6931471805599453 * (now - greatest(x.t, y.t)) / 2.0) END) AS warm FROM last x JOIN last y ON x.b = y.b, now WHERE x.a >= 0 AND x.a % 20 = 0 AND x.a <> y.a GROUP BY 1, 2),
p AS (SELECT nu.a AS u, nv.a AS v, coalesce(common, 0) AS common, (0.40 * coalesce(warm, 0) + 0.25 * (nu.memory + nv.memory) / 2 + 0.35 * (nu.recent + nv.recent) / 2) / (1 + coalesce(common, 0) + nu.strength + nv.strength) AS s FROM node nu JOIN node nv ON nu.a <> nv.a LEFT JOIN f ON f.u = nu.a AND f.v = nv.a WHERE nu.a >= 0 AND nu.a % 20 = 0 AND NOT EXISTS (SELECT 1 FROM last l WHERE l.a = nu.a AND l.b = nv.a)),
r AS (SELECT u, v, common, round(s, 6) AS score FROM p WHERE s >= 0.05)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY u ORDER BY score DESC, v) <= 20""")
def temporal_link_prediction(spark, sf_dir):
    """Query nodes are the parts whose key is divisible by 20, against all nodes; contacts are shipments, in years; the best twenty of each."""
    t = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) / 365)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("subject"), (-F.col("l_suppkey") - 1).alias("object"), t.alias("t"), F.lit(1.0).alias("weight"), F.lit(0.6).alias("confidence"))
    queries = rows.where("subject % 20 = 0").select(F.col("subject").alias("node")).distinct()
    return L.best_temporal(rows, queries, 20)


@query("hits_and_mrr", f"""WITH {TRIPLETS_SQL}, early AS (SELECT subject, object, count(*) AS n FROM triplets WHERE day < '2024-01-15' GROUP BY ALL), r AS (SELECT subject AS u, object AS v, row_number() OVER (PARTITION BY subject ORDER BY n DESC, object) AS rank FROM early),
gold AS (SELECT DISTINCT subject AS u, object AS v FROM triplets WHERE day >= '2024-01-15'), h AS (SELECT rank FROM r JOIN gold USING (u, v))
SELECT round(count(*) FILTER (rank <= 1) / greatest(1, (SELECT count(*) FROM gold)), 6) AS hits_at_1, round(count(*) FILTER (rank <= 5) / greatest(1, (SELECT count(*) FROM gold)), 6) AS hits_at_5, round(count(*) FILTER (rank <= 10) / greatest(1, (SELECT count(*) FROM gold)), 6) AS hits_at_10, round(coalesce(sum(1.0 / rank), 0) / greatest(1, (SELECT count(*) FROM gold)), 6) AS mrr FROM h""")
def hits_and_mrr(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = _triplets(spark, sf_dir).select("day", F.col("subject").alias("u"), F.col("object").alias("v"))
    early = rows.where("day < '2024-01-15'").groupBy("u", "v").agg(F.count(F.lit(1)).alias("n"))
    ranked = early.withColumn("rank", F.row_number().over(W.partitionBy("u").orderBy(F.desc("n"), "v")))
    out = L.hits_and_mrr(ranked, rows.where("day >= '2024-01-15'").select("u", "v"))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("confidence_gate", f"WITH {EDGES_SQL} SELECT CASE WHEN mean_value / 100 >= 0.5 THEN 'kept' ELSE 'rejected' END AS verdict, count(*) AS n, sum(total_count) AS events FROM edges GROUP BY 1")
def confidence_gate(spark, sf_dir):
    edges = R.confidence_gate(_edges(spark, sf_dir).withColumn("mean_confidence", F.col("mean_value") / 100))
    return edges.groupBy(F.when(F.col("passed"), "kept").otherwise("rejected").alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.sum("total_count").alias("events"))


@query("expert_overrides", f"""WITH {EDGES_SQL}, ov AS (SELECT 'u' || user_id AS subject, sum(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN -1.0 ELSE 0.0 END) AS w FROM events WHERE value >= 90 GROUP BY 1)
SELECT e.subject, e.predicate, e.object, e.total_count, coalesce(w, 0.0) AS expert_weight, round(ln(1 + CAST(total_count AS DOUBLE)) + 1.5 * coalesce(w, 0.0), 6) AS score FROM edges e LEFT JOIN ov ON e.subject = ov.subject""")
def expert_overrides(spark, sf_dir):
    reviews = table(spark, sf_dir, "events").where("value >= 90")
    verdict = F.when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "error", "reject").otherwise("review")
    overrides = reviews.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject"), E.verdict_weight(verdict).alias("weight"))
    out = E.apply_overrides(_edges(spark, sf_dir), overrides, ["subject"])
    zero = F.lit(0.0)
    return out.select("subject", "predicate", "object", "total_count", "expert_weight", F.round(G.linear_score(F.log1p("total_count"), zero, zero, zero, F.col("expert_weight")), 6).alias("score"))


@query("bitemporal_intervals", f"WITH {EDGES_SQL} SELECT subject, predicate, object, 'evidence:' || first_day || '..' || last_day || '|valid:' || first_day || '..' || CASE WHEN active_days > 1 THEN last_day ELSE '+inf' END AS time_interval FROM edges")
def bitemporal_intervals(spark, sf_dir):
    to = F.when(F.col("active_days") > 1, F.col("last_day"))
    return _edges(spark, sf_dir).select("subject", "predicate", "object", E.bitemporal(F.col("first_day"), F.col("last_day"), F.col("first_day"), to).alias("time_interval"))


@query("corrections", """WITH f AS (SELECT event_id % 500 AS event_id, CASE WHEN event_id % 3 = 0 THEN 'corrected' END AS event_type, CASE WHEN event_id % 3 = 1 THEN value END AS value, event_id AS seq FROM events WHERE value < 5),
c AS (SELECT event_id, arg_max(event_type, seq) FILTER (event_type IS NOT NULL OR value IS NOT NULL) AS t0, max(seq) FILTER (event_type IS NOT NULL OR value IS NOT NULL) AS seq FROM f GROUP BY 1 HAVING count(*) FILTER (event_type IS NOT NULL OR value IS NOT NULL) > 0),
n AS (SELECT f.event_id, f.event_type, f.value FROM f JOIN c ON f.event_id = c.event_id AND f.seq = c.seq), o AS (SELECT e.event_id, e.event_type, e.value, CASE WHEN n.event_id IS NULL THEN 'current' ELSE 'replaced' END AS status, 1 AS version FROM events e LEFT JOIN n ON e.event_id = n.event_id)
SELECT * FROM o UNION ALL SELECT e.event_id, coalesce(n.event_type, e.event_type), coalesce(n.value, e.value), 'current', 2 FROM events e JOIN n ON e.event_id = n.event_id""")
def corrections(spark, sf_dir):
    """Corrections of the first 500 events, some repeated, some of one field, some empty: the last that says something counts."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    kind = F.col("event_id") % 3
    fixes = rows.where("value < 5").select((F.col("event_id") % 500).alias("event_id"), F.when(kind == 0, "corrected").alias("event_type"), F.when(kind == 1, F.col("value")).alias("value"), F.col("event_id").alias("seq"))
    return E.corrected(rows, fixes, "event_id", ["event_type", "value"], "seq")


@query("latest_state", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_state(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return E.latest(rows, ["user_id"], "event_id")


@query("first_wins", "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def first_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return E.first_wins(rows, ["user_id", "event_type"], ["event_id"])


@query("yearly_direction", """WITH y AS (SELECT o_custkey AS node, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY 1, 2), f AS (SELECT node, min(year) AS first_year, max(year) AS last_year, arg_min(n, year) AS n0, arg_max(n, year) AS n1, count(*) AS k FROM y GROUP BY node)
SELECT node, first_year, last_year, CASE WHEN k = 1 THEN 'stable' WHEN n1 > n0 THEN 'strengthening' WHEN n1 < n0 THEN 'weakening' ELSE 'persistent' END AS direction FROM f""")
def yearly_direction(spark, sf_dir):
    per_year = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    ends = per_year.groupBy("node").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("n", "year").alias("n0"), F.max_by("n", "year").alias("n1"), F.count(F.lit(1)).alias("k"))
    return ends.select("node", "first_year", "last_year", F.when(F.col("k") == 1, "stable").when(F.col("n1") > F.col("n0"), "strengthening").when(F.col("n1") < F.col("n0"), "weakening").otherwise("persistent").alias("direction"))


TRIAGE_SQL = """t AS (SELECT subject, predicate, object, mean_value, active_days, total_count, CASE predicate WHEN 'error' THEN 'thanks' WHEN 'purchase' THEN 'causes' WHEN 'click' THEN 'mentions' WHEN 'view' THEN 'is_shown_in' ELSE 'improves' END AS p FROM edges),
s AS (SELECT *, CASE WHEN length(object) <= 2 THEN 0.0 ELSE 0.0 END + CASE WHEN p IN ('thanks', 'is_shown_in') THEN -3.0 ELSE 0.0 END + CASE WHEN p IN ('causes', 'improves') THEN 2.0 ELSE 0.0 END + CASE WHEN mean_value / 100 >= 0.3 THEN 1.5 WHEN mean_value / 100 >= 0.15 THEN 0.5 ELSE 0.0 END + CASE WHEN active_days > 1 THEN 2.0 ELSE 0.0 END
 + CASE WHEN p = 'thanks' THEN -2.0 WHEN p = 'causes' THEN 1.0 ELSE 0.0 END + CASE WHEN p = 'mentions' THEN CASE WHEN mean_value / 100 >= 0.7 THEN 2.5 WHEN mean_value / 100 >= 0.4 THEN 1.0 WHEN mean_value / 100 < 0.2 THEN -2.0 ELSE 0.0 END ELSE 0.0 END + CASE WHEN object IN ('k7', 'k8') THEN -2.0 ELSE 0.0 END AS score FROM t)"""


def _triaged(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    named = F.when(F.col("predicate") == "error", "thanks").when(F.col("predicate") == "purchase", "causes").when(F.col("predicate") == "click", "mentions").when(F.col("predicate") == "view", "is_shown_in").otherwise("improves")
    said = F.when(named == "thanks", "We thank the anonymous reviewers.").when(named == "causes", "The effect was seen in all of the samples.")
    object_ = F.when(F.col("object") == "k7", "Table 3").when(F.col("object") == "k8", "results").otherwise(F.concat(F.lit("item "), "object"))
    rows = edges.select("subject", named.alias("predicate"), object_.alias("object"), said.alias("snippet"), (F.col("mean_value") / 100).alias("importance"), F.col("active_days").alias("papers"), F.when(named == "mentions", F.col("mean_value") / 100).alias("quality"), F.col("predicate").alias("given"), F.col("object").alias("key"))
    return Q.triage(rows)


@query("triage_verdicts", f"WITH {EDGES_SQL}, {TRIAGE_SQL} SELECT subject, predicate, object, score, CASE WHEN score >= 2 THEN 'accept' WHEN score <= -2 THEN 'reject' ELSE 'review' END AS verdict FROM s")
def triage_verdicts(spark, sf_dir):
    """Edges with predicates of every kind, evidence that is thanks or science, and objects that are noise."""
    return _triaged(spark, sf_dir).select("subject", F.col("given").alias("predicate"), F.col("key").alias("object"), F.col("triage_score").alias("score"), "verdict")


@query("triage_summary", f"WITH {EDGES_SQL}, {TRIAGE_SQL} SELECT count(*) FILTER (score >= 2) AS accept, count(*) FILTER (score <= -2) AS reject, count(*) FILTER (score > -2 AND score < 2) AS review FROM s")
def triage_summary(spark, sf_dir):
    v = F.col("verdict")
    return _triaged(spark, sf_dir).agg(*(F.count_if(v == name).alias(name) for name in ("accept", "reject", "review")))


@query("graph_f1", f"""WITH {TRIPLETS_SQL}, p AS (SELECT DISTINCT subject, object FROM triplets WHERE day < '2024-01-15'), g AS (SELECT DISTINCT subject, object FROM triplets WHERE day >= '2024-01-15'),
c AS (SELECT coalesce(p.subject, g.subject) AS subject, count(p.subject) AS np, count(g.subject) AS ng, count(*) FILTER (p.subject IS NOT NULL AND g.subject IS NOT NULL) AS m FROM p FULL JOIN g ON p.subject = g.subject AND p.object = g.object GROUP BY 1)
SELECT subject, np AS n_predicted, ng AS n_gold, m AS n_matched, round(CASE WHEN np + ng > 0 THEN 2.0 * (2.0 * m / (np + ng)) - 1 ELSE -1 END, 6) AS reward FROM c""")
def graph_f1(spark, sf_dir):
    """Reward 2 F1 - 1 of a user's early keys as a prediction of the late ones."""
    rows = _triplets(spark, sf_dir).select("day", "subject", "object")
    sides = rows.groupBy("subject", "object").agg(F.bool_or(F.col("day") < "2024-01-15").alias("p"), F.bool_or(F.col("day") >= "2024-01-15").alias("g"))
    counts = sides.groupBy("subject").agg(F.count_if("p").alias("n_predicted"), F.count_if("g").alias("n_gold"), F.count_if(F.col("p") & F.col("g")).alias("n_matched"))
    f1 = 2.0 * F.col("n_matched") / (F.col("n_predicted") + F.col("n_gold"))
    return counts.withColumn("reward", F.round(2.0 * f1 - 1, 6))


@query("verdict_words", """SELECT o_orderpriority, CASE WHEN o_orderpriority LIKE '%URGENT' THEN 'reject' WHEN o_orderpriority LIKE '%HIGH' THEN 'accept' ELSE 'revise' END AS verdict, count(*) AS n FROM orders GROUP BY 1, 2""")
def verdict_words(spark, sf_dir):
    words = F.when(F.col("o_orderpriority").endswith("URGENT"), "Not correct").when(F.col("o_orderpriority").endswith("HIGH"), " Accepted ").otherwise("needs work")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", T.verdict(words).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("ab_sides", "SELECT CASE WHEN substring(sha256(CAST(conv_id AS VARCHAR)), 8, 1) IN ('0','2','4','6','8','a','c','e') THEN 'A' ELSE 'B' END AS side, count(DISTINCT conv_id) AS n FROM conversations GROUP BY 1")
def ab_sides(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(K.side(F.col("conv_id").cast("string")).alias("side")).agg(F.countDistinct("conv_id").alias("n"))
