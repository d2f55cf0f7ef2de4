"""Queries over predicates, rule-based triplets, merged names, candidates and reviewed assertions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import events as E
from lodestar.operators import hypotheses as H
from lodestar.operators import knowledge as G
from lodestar.operators import matching as M
from lodestar.operators import reviews as R
from lodestar.operators import triplets as X
from lodestar.plans.event_queries import EDGES_SQL, TRIPLETS_SQL
from lodestar.plans.knowledge_queries import SCORED_SQL, _found
from lodestar.plans.registry import query, table

PREDICATES = (*G.PREDICATE_STRENGTH, "mentions", "Thanks ", "unheard_of")
STRENGTHS_SQL = ", ".join(f"({k}, '{p}', {G.PREDICATE_STRENGTH.get(p.strip().lower(), G.DEFAULT_STRENGTH)})" for k, p in enumerate(PREDICATES))


@query("predicate_strengths", f"SELECT p_partkey, predicate, CAST(strength AS DOUBLE) AS strength FROM part JOIN (VALUES {STRENGTHS_SQL}) v(k, predicate, strength) ON p_partkey % {len(PREDICATES)} = k")
def predicate_strengths(spark, sf_dir):
    """Every predicate of the table, and some that are not in it."""
    names = F.array(*map(F.lit, PREDICATES))
    own = table(spark, sf_dir, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % len(PREDICATES) + 1).cast("int")).alias("predicate"))
    return own.withColumn("strength", G.strength(F.col("predicate")))


# Verb phrases as a sentence may have them, with what the rules must make of them.
VERBS = (
    ("directly causes", "causes", 0.9, "supports"),
    ("leads to", "leads_to", 0.87, "supports"),
    ("gives rise to", "leads_to", 0.87, "supports"),
    ("significantly boosts", "improves", 0.82, "supports"),
    ("inhibits", "inhibits", 0.84, "supports"),
    ("decreases", "reduces", 0.84, "supports"),
    ("occurs before", "precedes", 0.83, "supports"),
    ("follows", "follows", 0.83, "supports"),
    ("is followed by", "precedes", 0.8, "supports"),
    ("was linked to", "associated_with", 0.56, "unknown"),
    ("worsens", "worsens", 0.74, "contradicts"),
)
VERBS_SQL = ", ".join(f"({k}, '{p}', {c}, '{o}')" for k, (_, p, c, o) in enumerate(VERBS))


@query("rule_triplets", f"""WITH p AS (SELECT p_partkey, replace(p_brand, '#', 'x') AS b, p_type AS t, p_size, p_partkey % 12 AS v FROM part)
SELECT p_partkey, 1 AS place, b AS subject, CASE WHEN v = 11 THEN 'associated_with' ELSE predicate END AS predicate, t AS object, CAST(CASE WHEN v = 11 THEN 0.46 ELSE confidence END AS DOUBLE) AS confidence, CASE WHEN v = 11 THEN 'unknown' ELSE polarity END AS polarity,
CASE WHEN p_size % 2 = 0 THEN '2005-03' ELSE CAST(1990 + p_size AS VARCHAR) END AS time, CASE WHEN p_size % 2 = 0 THEN 'extracted' ELSE 'paper_year_fallback' END AS time_source
FROM p LEFT JOIN (VALUES {VERBS_SQL}) x(k, predicate, confidence, polarity) ON v = k""")
def rule_triplets(spark, sf_dir):
    """A sentence of every part goes in, of each relation or, for one in twelve, of two bare entities."""
    verb = F.element_at(F.array(*(F.lit(v) for v, *_ in VERBS), F.lit("")), (F.col("p_partkey") % 12 + 1).cast("int"))
    brand = F.regexp_replace("p_brand", "#", "x")
    told = F.when(F.col("p_partkey") % 12 == 11, F.concat(brand, F.lit("; "), "p_type", F.lit("."))).otherwise(F.concat(F.lit("The "), brand, F.lit(" "), verb, F.lit(" the "), "p_type", F.lit(".")))
    dated = F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("2005-03; ")).otherwise(F.lit("")), told, F.lit(" "))
    rows = table(spark, sf_dir, "part").select("p_partkey", dated.alias("text"), (F.col("p_size") + 1990).alias("year"))
    return X.extract(rows, "p_partkey", "text", "year").drop("quote")


@query("triplet_choice", f"""WITH {TRIPLETS_SQL}, r AS (SELECT subject, CASE predicate WHEN 'view' THEN 'shows' WHEN 'click' THEN 'leads to' WHEN 'purchase' THEN 'causes' ELSE 'relates to' END AS p, object, value / 100 AS c, event_id, CASE predicate WHEN 'click' THEN 0 WHEN 'purchase' THEN 0 ELSE 1 END AS weak, CASE predicate WHEN 'click' THEN 1.0 WHEN 'purchase' THEN 1.0 ELSE 0.25 END AS s FROM triplets),
o AS (SELECT subject, replace(p, ' ', '_') AS predicate, object, arg_min(c, event_id) AS c, min(event_id) AS e, min(weak) AS weak, min(s) AS s FROM r WHERE p <> 'shows' GROUP BY ALL)
SELECT subject AS key, CAST(place AS INT) AS place, predicate, object, round(c, 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY weak, s DESC, c DESC, e) AS place FROM o) WHERE place <= 10""")
def triplet_choice(spark, sf_dir):
    """The ten best of a user's triplets: strong predicates first, weak ones gone, equal ones once."""
    named = F.when(F.col("predicate") == "view", "shows").when(F.col("predicate") == "click", "leads to").when(F.col("predicate") == "purchase", "causes").otherwise("relates to")
    rows = E.triplets(table(spark, sf_dir, "events"))
    rows = rows.select(F.col("subject").alias("key"), F.col("event_id").alias("pos"), F.concat(F.lit("item "), "subject").alias("subject"), named.alias("predicate"), F.concat(F.lit("thing "), "object").alias("object"), (F.col("value") / 100).alias("confidence"), F.lit(None).cast("string").alias("time"), F.lit("").alias("quote"))
    return X.chosen(rows, "key").select("key", "place", "predicate", F.regexp_replace("object", "^thing ", "").alias("object"), F.round("confidence", 6).alias("confidence"))


NAMES_SQL = "names AS (SELECT 'item ' || p_partkey AS name, p_size AS n, p_partkey FROM part UNION ALL SELECT 'item ' || p_partkey || ' extra', p_partkey % 60, p_partkey FROM part), canon AS (SELECT p_partkey, CASE WHEN p_size >= p_partkey % 60 THEN 'item ' || p_partkey ELSE 'item ' || p_partkey || ' extra' END AS canonical FROM part)"


def _names(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    plain = F.concat(F.lit("item "), F.col("p_partkey").cast("string"))
    return parts.select(plain.alias("name"), F.col("p_size").cast("long").alias("n")).union(parts.select(F.concat(plain, F.lit(" extra")), (F.col("p_partkey") % 60).cast("long")))


def _renames(spark, sf_dir):
    names = _names(spark, sf_dir)
    pairs = M.token_pairs(names.select(F.col("name").alias("k"), F.split("name", " ").alias("x")), "k", "x", 0.85)
    return M.fuzzy_names(pairs.select("a", "b"), names)


@query("fuzzy_merge", f"WITH {NAMES_SQL} SELECT name, canonical FROM names JOIN canon USING (p_partkey) WHERE name <> canonical")
def fuzzy_merge(spark, sf_dir):
    """Names of parts with and without a further word: the more frequent one takes in the other."""
    return _renames(spark, sf_dir)


@query("fuzzy_edges", """WITH canon AS (SELECT p_partkey, CASE WHEN p_size >= p_partkey % 60 THEN 'item ' || p_partkey ELSE 'item ' || p_partkey || ' extra' END AS canonical FROM part)
SELECT canonical AS source, 'supplier ' || l_suppkey AS target, l_returnflag AS predicate, count(*) AS total_count, CAST(sum(l_linenumber) AS BIGINT) AS weight FROM lineitem JOIN canon ON l_partkey = p_partkey GROUP BY ALL""")
def fuzzy_edges(spark, sf_dir):
    """Edges of both names of a part to its suppliers, added up under the canonical name."""
    lines = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("item "), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, " extra").otherwise(""))
    edges = lines.groupBy(name.alias("source"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("target"), F.col("l_returnflag").alias("predicate")).agg(F.count(F.lit(1)).alias("total_count"), F.sum(F.col("l_linenumber").cast("long")).alias("weight"))
    return M.renamed_edges(edges, _renames(spark, sf_dir), ["predicate"], ["total_count", "weight"])


@query("fuzzy_nodes", f"WITH {NAMES_SQL} SELECT canonical AS name, CAST(sum(n) AS BIGINT) AS n FROM names JOIN canon USING (p_partkey) GROUP BY 1")
def fuzzy_nodes(spark, sf_dir):
    return M.renamed_nodes(_names(spark, sf_dir), _renames(spark, sf_dir), ["n"])


ROUNDED_SQL = SCORED_SQL + ", s AS MATERIALIZED (SELECT source, target, total_count, round(trend, 6) AS trend, round(log_count + 0.75 * pmi + 1.25 * trend + 0.2, 6) AS score FROM feat)"
LINKS_SQL = ROUNDED_SQL + """, top AS MATERIALIZED (SELECT source, target FROM s WHERE source <> target ORDER BY score DESC, source, target LIMIT 400), w AS MATERIALIZED (SELECT source AS a, target AS b FROM top UNION SELECT target, source FROM top),
links AS MATERIALIZED (SELECT x.a AS source, y.a AS target, CAST(count(*) AS DOUBLE) AS score FROM w x JOIN w y ON x.b = y.b AND x.a < y.a WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.a = x.a AND w.b = y.a) GROUP BY 1, 2 ORDER BY score DESC, 1, 2 LIMIT 10)"""


def _rounded(spark, sf_dir):
    return G.scored_edges(*_found(spark, sf_dir)).select("source", "target", "total_count", F.round("trend", 6).alias("trend"), F.round("score", 6).alias("score"))


@query("missing_links", f"WITH {LINKS_SQL} SELECT source, target, score FROM links")
def missing_links(spark, sf_dir):
    return H.missing_links(_rounded(spark, sf_dir), 10)


@query("missing_link_evidence", f"WITH {LINKS_SQL} SELECT source, target, CAST(place AS INT) AS place, paper_id FROM (SELECT source, target, paper_id, row_number() OVER (PARTITION BY source, target ORDER BY paper_id) AS place FROM links JOIN papers ON contains(lower(text), source) AND contains(lower(text), target)) WHERE place <= 3")
def missing_link_evidence(spark, sf_dir):
    """The first three documents that mention both ends of each missing link."""
    papers = G.papers_of(table(spark, sf_dir, "documents"))
    return H.term_evidence(H.missing_links(_rounded(spark, sf_dir), 10), papers).drop("snippet")


@query("all_candidates", f"""WITH {LINKS_SQL}, e AS (SELECT source, target, 'cooccurs_with' AS predicate, score, 'emerging_edge' AS kind, 0 AS branch FROM s WHERE total_count >= 2 AND trend > 0.05 ORDER BY score DESC, source, target LIMIT 10),
t AS (SELECT source, target, 'cooccurs_with' AS predicate, score, 'top_edge' AS kind, 0 AS branch FROM s WHERE NOT EXISTS (SELECT 1 FROM e) ORDER BY score DESC, source, target LIMIT 10)
SELECT source, target, predicate, score, kind FROM (SELECT * FROM e UNION ALL SELECT * FROM t UNION ALL SELECT source, target, 'may_relate_to', score, 'missing_link', 1 FROM links) ORDER BY score DESC, branch, source, target LIMIT 10""")
def all_candidates(spark, sf_dir):
    """The ten best of emerging edges and missing links; the other two lists are empty here."""
    edges = _rounded(spark, sf_dir)
    none = spark.createDataFrame([], "source string, target string, score double, kind string")
    return H.all_candidates(H.candidates(edges, 10), H.missing_links(edges, 10), none.drop("kind"), none, 10)


@query("agent_candidates", """WITH r AS (SELECT l_partkey AS u, l_suppkey + 100000 AS v, sum(l_linenumber) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT p_partkey AS node, p_size / 50 AS rank FROM part WHERE p_partkey % 2 = 0),
a AS (SELECT u, v, CASE WHEN n > 1 THEN 0.25 WHEN s % 2 = 0 THEN 0.1 ELSE 0.15 END AS boost, CASE WHEN n > 1 THEN 'cross_bridge' WHEN s % 2 = 0 THEN 'link_prediction' ELSE 'central_emergence' END AS kind, CAST(s AS DOUBLE) AS s FROM r)
SELECT u AS source, v AS target, round(s + boost * coalesce(rank, 0), 6) AS score, kind FROM a LEFT JOIN k ON u = node ORDER BY s + boost * coalesce(rank, 0) DESC, u, v LIMIT 20""")
def agent_candidates(spark, sf_dir):
    """Pairs of parts and suppliers in three overlapping lists, some the other way round, lifted by the size of the part.

    Ends are (kind, key), so no key of a supplier is taken for one of a part.
    """
    end = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.col(key).alias("key"))
    pairs = table(spark, sf_dir, "lineitem").groupBy(end(0, "l_partkey").alias("u"), end(1, "l_suppkey").alias("v")).agg(F.sum(F.col("l_linenumber").cast("double")).alias("score"), F.count(F.lit(1)).alias("n"))
    bridges = pairs.where("n > 1").select(F.col("v").alias("u"), F.col("u").alias("v"), "score")
    ranks = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(end(0, "p_partkey").alias("node"), (F.col("p_size") / 50).alias("rank"))
    out = H.agent_candidates(bridges, pairs.where("n > 1 OR score % 2 = 0"), pairs.select("u", "v", "score"), ranks, 20)
    return out.select(F.col("source.key").alias("source"), (F.col("target.key") + 100000).alias("target"), F.round("score", 6).alias("score"), "kind")


@query("candidate_context", """WITH c AS (SELECT c_custkey AS source, c_nationkey AS target FROM customer), y AS (SELECT o_custkey AS source, CAST(year(o_orderdate) AS INT) AS year, count(*) AS n FROM orders GROUP BY 1, 2), e AS (SELECT source, min(year) AS a, max(year) AS b, arg_min(n, year) AS x, arg_max(n, year) AS z, count(*) AS k FROM y GROUP BY 1),
p AS (SELECT s_nationkey AS nation, min(s_suppkey) AS pos, arg_min(s_acctbal, s_suppkey) AS score FROM supplier GROUP BY 1)
SELECT c.source, c.target, score AS prediction, a AS first_seen, b AS last_seen, CASE WHEN e.source IS NULL THEN 'predicted_or_missing' WHEN k < 2 THEN 'stable' WHEN z > x THEN 'strengthening' WHEN z < x THEN 'weakening' ELSE 'persistent' END AS ordering FROM c LEFT JOIN e ON c.source = e.source LEFT JOIN p ON c.target = nation""")
def candidate_context(spark, sf_dir):
    """Customers and their nations as candidates, orders as the edge's years, suppliers of the nation as predictions in the other direction."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").cast("long").alias("target"), F.lit("orders").alias("predicate"), F.lit("emerging_edge").alias("kind"))
    years = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("yearly_count"))
    edges = years.join(c.select("source", "target", "predicate"), "source")
    predictions = c.select("source", "target").distinct().join(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("target"), F.col("s_suppkey").alias("pos"), F.col("s_acctbal").alias("score")), "target").select(F.col("target").alias("source"), F.col("source").alias("target"), "pos", "score")
    return H.with_edges(H.matched_predictions(c, predictions), edges).drop("predicate", "kind")


@query("triplet_matches", """WITH c AS (SELECT n_nationkey AS key, n_name AS s, r_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey), x AS (SELECT s_suppkey AS pos, n_name || ' trade' AS a, r_name AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (SELECT key, pos, row_number() OVER (PARTITION BY key ORDER BY pos) AS place FROM c JOIN x ON (contains(lower(a), lower(s)) OR contains(lower(s), lower(a))) AND (contains(lower(b), lower(t)) OR contains(lower(t), lower(b)))) SELECT key, CAST(place AS INT) AS place, pos FROM m WHERE place <= 6""")
def triplet_matches(spark, sf_dir):
    """Nations and regions as candidates, suppliers as triplets that say them the other way round."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("lies in").alias("predicate"))
    rows = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("pos"), F.col("r_name").alias("subject"), F.lit("holds").alias("predicate"), F.concat("n_name", F.lit(" trade")).alias("object"))
    return H.matched_triplets(own, rows)


SPANS_SQL = "d AS (SELECT *, CASE predicate WHEN 'view' THEN substring(day, 1, 7) WHEN 'click' THEN substring(day, 1, 4) ELSE day END AS date FROM triplets)"


def _intervals(spark, sf_dir):
    """Events as intervals: of views the month, of clicks the year, of others the day; only purchases and errors are extracted."""
    date = F.when(F.col("predicate") == "view", F.substring("day", 1, 7)).when(F.col("predicate") == "click", F.substring("day", 1, 4)).otherwise(F.col("day"))
    source = F.when(F.col("predicate").isin("purchase", "error"), "extracted").otherwise("paper")
    rows = E.triplets(table(spark, sf_dir, "events"))
    none = F.lit(None).cast("string")
    rows = rows.select("subject", "predicate", "object", "event_id", date.alias("start"), none.alias("end"), F.lit("day").alias("granularity"), source.alias("source"), none.alias("paper_id"), none.alias("unit_id"))
    return R.unique_intervals(rows, ["subject", "predicate", "object"], "event_id")


@query("unique_intervals", f"WITH {TRIPLETS_SQL}, {SPANS_SQL}, o AS (SELECT subject, predicate, object, date, min(event_id) AS e FROM d GROUP BY ALL) SELECT subject, predicate, object, string_agg(date, ',' ORDER BY e) AS dates FROM o GROUP BY ALL")
def unique_intervals(spark, sf_dir):
    return _intervals(spark, sf_dir).select("subject", "predicate", "object", F.array_join(F.transform("time_intervals", lambda x: x["start"]), ",").alias("dates"))


@query("flattened_edges", f"""WITH {TRIPLETS_SQL}, {SPANS_SQL}, e AS (SELECT subject, predicate, object, count(*) AS n, min(date) AS a, max(date) AS b, count(DISTINCT date) AS k FROM d GROUP BY ALL)
SELECT 'auto-' || printf('%05d', row_number() OVER (ORDER BY n DESC, subject, predicate, object)) AS assertion_id, subject, predicate, object, a AS start_date, b AS end_date, CASE WHEN predicate IN ('purchase', 'error') THEN 'triplet_extractor' ELSE 'paper_year_fallback' END AS time_source, 'evidence:' || a || '..' || b || '|valid:' || a || '..' || b AS time_interval FROM e""")
def flattened_edges(spark, sf_dir):
    counts = E.edge_counts(E.triplets(table(spark, sf_dir, "events"))).select("subject", "predicate", "object", F.col("total_count").cast("double").alias("score"))
    edges = counts.join(_intervals(spark, sf_dir), ["subject", "predicate", "object"]).withColumn("years", F.lit(None).cast("array<int>"))
    return R.flattened(edges).drop("valid_from", "valid_to")


# Phrases with the role and the causal status that they tell.
ROLE_PHRASES = (
    ("contradicts earlier work", "contradiction", "descriptive"), ("leads to effects", "mechanism", "causal"), ("drug use correlates", "intervention", "correlational"), ("assay readout", "measurement", "descriptive"),
    ("only when warm", "boundary_condition", "descriptive"), ("plain words", "background", "descriptive"), ("authors suggest it", "background", "theoretical"), ("mediates stimulation", "intervention", "causal"),
)
ROLES_SQL = ", ".join(f"({k}, '{r}', '{c}')" for k, (_, r, c) in enumerate(ROLE_PHRASES))


@query("assertion_roles", f"SELECT p_partkey, role, status, CASE WHEN p_size % 3 = 0 THEN 'publication_time' ELSE 'observation_period' END AS time_type, '' AS verdict, 'warning' AS severity FROM part JOIN (VALUES {ROLES_SQL}) v(k, role, status) ON p_partkey % 8 = k")
def assertion_roles(spark, sf_dir):
    said = F.element_at(F.array(*(F.lit(p) for p, *_ in ROLE_PHRASES)), (F.col("p_partkey") % 8 + 1).cast("int"))
    rows = R.prefilled(table(spark, sf_dir, "part"), F.lit(2020))
    time = R.time_type(F.when(F.col("p_size") % 3 == 0, "Metadata").otherwise("extracted"))
    none = F.lit("")
    return rows.select("p_partkey", R.hypothesis_role(none, none, none, said).alias("role"), R.causal_status(none, said).alias("status"), time.alias("time_type"), "verdict", "severity")


@query("review_overrides", f"""WITH {TRIPLETS_SQL}, a AS (SELECT CAST(substring(subject, 2) AS BIGINT) AS doc_id, CASE WHEN CAST(substring(subject, 2) AS BIGINT) % 2 = 0 THEN CASE predicate WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'needs_time_fix' ELSE 'uncertain' END ELSE CASE predicate WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' ELSE 'added' END END AS verdict FROM triplets)
SELECT doc_id, verdict, count(*) AS n, sum(CASE verdict WHEN 'accepted' THEN 1.0 WHEN 'rejected' THEN -1.0 WHEN 'needs_time_fix' THEN -0.25 WHEN 'added' THEN 0.75 ELSE 0.0 END) AS weight FROM a GROUP BY ALL""")
def review_overrides(spark, sf_dir):
    """Reviews of users: those of even users in the new form, the others as lists of accepted, rejected and added edges."""
    rows = E.triplets(table(spark, sf_dir, "events")).withColumn("doc_id", F.substring("subject", 2, 20).cast("long"))
    edge = F.struct("subject", "predicate", "object")
    verdict = F.when(F.col("predicate") == "purchase", "accepted").when(F.col("predicate") == "error", "needs_time_fix").otherwise("uncertain")
    new = F.collect_list(F.when(F.col("doc_id") % 2 == 0, F.struct("subject", "predicate", "object", verdict.alias("verdict"))))
    old = lambda test: F.collect_list(F.when((F.col("doc_id") % 2 == 1) & test, edge))
    p = F.col("predicate")
    docs = rows.groupBy("doc_id").agg(new.alias("assertions"), old(p == "purchase").alias("accepted_edges"), old(p == "error").alias("rejected_edges"), old(~p.isin("purchase", "error")).alias("added_edges"))
    weights = R.compiled_overrides(R.review_assertions(docs)).withColumn("doc_id", F.substring("subject", 2, 20).cast("long"))
    return weights.groupBy("doc_id", "verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@query("fallback_verdicts", f"""WITH {EDGES_SQL}, q AS (SELECT *, CASE predicate WHEN 'view' THEN 'related_to' ELSE predicate END AS p, mean_value / 100 AS conf, CASE WHEN predicate = 'click' THEN mean_value / 100 END AS quality FROM edges)
SELECT p AS predicate, verdict, count(*) AS n FROM (SELECT p, CASE WHEN conf < 0.5 THEN 'rejected' WHEN p = 'related_to' THEN 'noise' WHEN quality IS NOT NULL THEN CASE WHEN quality >= 0.7 THEN 'valid' WHEN quality <= 0.25 THEN 'noise' ELSE 'speculative' END WHEN (total_count >= 2 AND conf >= 0.6) OR active_days >= 2 THEN 'valid' WHEN total_count = 1 AND conf < 0.5 THEN 'noise' ELSE 'speculative' END AS verdict FROM q) GROUP BY ALL""")
def fallback_verdicts(spark, sf_dir):
    edges = E.edge_counts(E.triplets(table(spark, sf_dir, "events")))
    conf = F.col("mean_value") / 100
    rows = edges.select(F.when(F.col("predicate") == "view", "related_to").otherwise(F.col("predicate")).alias("predicate"), F.when(F.col("predicate") == "click", conf).alias("quality"), "total_count", conf.alias("mean_confidence"), F.col("active_days").alias("papers"))
    return R.verified(rows).groupBy("predicate", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query("edge_support", """WITH e AS (SELECT l_suppkey AS source, l_partkey AS target, count(*) AS total_count, count(DISTINCT l_orderkey) AS papers_count, count(*) AS evidence_count, count(DISTINCT year(l_shipdate)) AS years, max(year(l_shipdate)) - min(year(l_shipdate)) + 1 AS span FROM lineitem GROUP BY 1, 2)
SELECT source, target, CAST(total_count AS DOUBLE) AS total_count, CAST(papers_count AS DOUBLE) AS papers_count, CAST(evidence_count AS DOUBLE) AS evidence_count, CAST(years AS DOUBLE) AS active_years_count, CAST(span AS DOUBLE) AS temporal_span_years, round(years / span, 6) AS temporal_density FROM e""")
def edge_support(spark, sf_dir):
    """Shipments as evidence: odd orders count by year, even ones as intervals."""
    lines = table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate"))
    odd, day = F.col("l_orderkey") % 2 == 1, F.date_format("l_shipdate", "yyyy-MM-dd")
    edges = lines.groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.collect_set(F.col("l_orderkey").cast("string")).alias("papers"),
        F.collect_list("l_returnflag").alias("evidence_quotes"),
        F.map_from_entries(F.transform(F.collect_set(F.when(odd, F.col("y"))), lambda y: F.struct(y, F.lit(1)))).alias("yearly_count"),
        F.collect_list(F.when(~odd, F.struct(day.alias("start"), F.lit(None).cast("string").alias("end")))).alias("time_intervals"),
    )
    out = R.edge_counts(edges)
    return out.select("source", "target", "total_count", "papers_count", "evidence_count", "active_years_count", "temporal_span_years", F.round("temporal_density", 6).alias("temporal_density"))


@query("compared_graphs", f"""WITH {EDGES_SQL} SELECT (SELECT count(*) FROM nation) AS reference_steps, (SELECT count(*) FROM region) AS reference_edges, count(*) AS automatic_edges, (SELECT count(DISTINCT t) FROM (SELECT subject AS t FROM edges UNION ALL SELECT object FROM edges)) AS automatic_unique_terms, (SELECT count(*) FROM supplier) AS resolved_papers, (SELECT count(*) FROM supplier WHERE 'u' || s_suppkey IN (SELECT subject FROM edges)) AS papers_reaching_automatic_graph FROM edges""")
def compared_graphs(spark, sf_dir):
    """Nations as steps, regions as their edges, suppliers as papers, users as the papers of their edges."""
    edges = E.edge_counts(E.triplets(table(spark, sf_dir, "events"))).select("subject", "object", F.array("subject").alias("papers"))
    links = table(spark, sf_dir, "region").select(F.lit("leads_to").alias("predicate")).union(table(spark, sf_dir, "nation").select(F.lit("cites")))
    papers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("id"))
    return R.compared(table(spark, sf_dir, "nation"), links, edges, papers)


@query("event_export", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m') END AS ts_start, CASE WHEN event_id % 3 = 0 THEN 'day' ELSE 'month' END AS granularity FROM events ORDER BY ts_start, event_id LIMIT 1000""")
def event_export(spark, sf_dir):
    """The first thousand events; two of three take their time from the month that they are linked to."""
    rows = table(spark, sf_dir, "events")
    month, own = F.date_format("ts", "yyyy-MM"), F.col("event_id") % 3 == 0
    none = F.lit(None).cast("string")
    events = rows.select("event_id", month.alias("time_id"), F.when(own, F.date_format("ts", "yyyy-MM-dd")).alias("ts_start"), none.alias("ts_end"), F.when(own, "day").alias("granularity"))
    times = rows.select(month.alias("time_id"), month.alias("start"), month.alias("end"), F.lit("month").alias("granularity")).distinct()
    return R.event_stream(events, times).select("event_id", "ts_start", "granularity")


@query("review_demos", f"""WITH {TRIPLETS_SQL} SELECT substring(sha1('temporal_triplets|science|' || subject || '|' || event_id || '|p'), 1, 16) AS id, CASE WHEN predicate = 'purchase' THEN 'gold' ELSE 'silver' END AS quality, '[' || subject || '] ' || CASE WHEN event_id % 2 = 0 THEN 'page=' || event_id ELSE '' END || chr(10) || 'seen ' || object AS chunk_text, '{{"subject":"' || subject || '","predicate":"' || predicate || '","object":"' || object || '"}}' AS triplet FROM triplets""")
def review_demos(spark, sf_dir):
    rows = E.triplets(table(spark, sf_dir, "events"))
    own = rows.select(F.lit("science").alias("domain"), F.col("subject").alias("paper_id"), F.col("event_id").cast("string").alias("assertion_id"), F.lit("p").alias("path"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("page"), F.lit("").alias("figure_or_table"), F.concat(F.lit("seen "), "object").alias("snippet"), "subject", "predicate", "object", F.when(F.col("predicate") == "purchase", "Accepted").otherwise("rejected").alias("verdict"))
    return R.review_demos(own).drop("domain")


@query("verification_batches", f"WITH {EDGES_SQL} SELECT subject, predicate, object, CAST((row_number() OVER (PARTITION BY predicate ORDER BY subject, object) - 1) // 80 AS BIGINT) AS batch FROM edges")
def verification_batches(spark, sf_dir):
    edges = E.edge_counts(E.triplets(table(spark, sf_dir, "events"))).select("subject", "predicate", "object")
    return R.batched(edges, "predicate", ["subject", "object"])


@query("partial_date_keys", f"WITH {TRIPLETS_SQL}, {SPANS_SQL} SELECT event_id, CASE length(date) WHEN 4 THEN date || '-99-99' WHEN 7 THEN date || '-99' ELSE date END AS sort_key, 'day:' || date || ':' || date AS interval_key FROM d")
def partial_date_keys(spark, sf_dir):
    date = F.when(F.col("predicate") == "view", F.substring("day", 1, 7)).when(F.col("predicate") == "click", F.substring("day", 1, 4)).otherwise(F.col("day"))
    rows = E.triplets(table(spark, sf_dir, "events")).select("event_id", date.alias("date"))
    return rows.select("event_id", R.date_key(F.col("date")).alias("sort_key"), R.interval_key(F.lit("day"), F.col("date"), F.lit(None).cast("string")).alias("interval_key"))
