"""Queries over the triplet graph, records from corrections, final ranking, indexes and nested values."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import events as E
from lodestar.operators import evaluation as V
from lodestar.operators import evidence as B
from lodestar.operators import extraction as X
from lodestar.operators import filters as Q
from lodestar.operators import graph as G
from lodestar.operators import hypotheses as H
from lodestar.operators import knowledge as KN
from lodestar.operators import reviews as S
from lodestar.operators import tables
from lodestar.operators import training as N
from lodestar.operators import triplets as R
from lodestar.operators import vectors as VC
from lodestar.plans.event_queries import TRIPLETS_SQL
from lodestar.plans.graph_queries import BASKET_SQL, _basket
from lodestar.plans.registry import query, table
from lodestar.plans.text_queries import STOP_SQL
from lodestar.plans.vector_queries import _nearest_sql
from lodestar.sources import papers as P
from lodestar.sources import sinks as K

# Lines as sentences: a brand, a verb by the line, a type; papers are orders, years those of shipment.
SAID_SQL = "said AS MATERIALIZED (SELECT l_orderkey AS paper, lower(replace(p_brand, '#', 'x')) AS s, ['causes', 'leads_to', 'reduces'][l_linenumber % 3 + 1] AS p, lower(p_type) AS o, [0.9, 0.87, 0.84][l_linenumber % 3 + 1] AS c, CAST(year(l_shipdate) AS INT) AS y FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _said(spark, sf_dir):
    verb = F.element_at(F.array(F.lit("causes"), F.lit("gives rise to"), F.lit("decreases")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = lines.select(key.alias("unit"), F.concat(F.regexp_replace("p_brand", "#", "x"), F.lit(" "), verb, F.lit(" "), "p_type", F.lit(".")).alias("text"), F.year("l_shipdate").alias("year"))
    found = R.extract(rows, "unit", "text", "year")
    return found.select(F.col("unit.l_orderkey").alias("paper_id"), "subject", "predicate", "object", "confidence", "polarity", F.substring("time", 1, 4).cast("int").alias("year"), "quote")


@query("triplet_graph", f"WITH {SAID_SQL} SELECT s AS subject, p AS predicate, o AS object, count(*) AS total_count, count(DISTINCT paper) AS papers, min(paper) AS first_paper, round(avg(c), 6) AS mean_confidence, count(*) AS supports, count(*) AS evidence_count, count(DISTINCT y) AS n_years FROM said GROUP BY ALL")
def triplet_graph(spark, sf_dir):
    """Triplets that the rules draw from sentences made of lines, as edges."""
    out = KN.triplet_edges(_said(spark, sf_dir))
    return out.select("subject", "predicate", "object", "total_count", "papers", "first_paper", F.round("mean_confidence", 6).alias("mean_confidence"), "supports", "evidence_count", F.size("yearly_count").cast("long").alias("n_years"))


@query("triplet_edge_scores", f"""WITH {SAID_SQL}, e AS (SELECT s, p, o, count(*) AS n, count(DISTINCT paper) AS papers, avg(c) AS c FROM said GROUP BY ALL), my AS (SELECT max(y) AS m, count(DISTINCT y) AS k FROM said), late AS (SELECT s, p, o, count(*) AS n FROM said, my WHERE y > m - 3 GROUP BY ALL),
t AS (SELECT term, count(DISTINCT paper) AS f FROM (SELECT paper, s AS term FROM said UNION ALL SELECT paper, o FROM said) GROUP BY 1), d AS (SELECT count(DISTINCT paper) AS n FROM said)
SELECT e.s AS subject, e.p AS predicate, e.o AS object, round(ln(1 + CAST(e.n AS DOUBLE)) + 0.75 * ln(CAST(papers AS DOUBLE) * d.n / (CAST(a.f AS DOUBLE) * b.f) + 1e-9) + 1.25 * (coalesce(late.n, 0) / e.n - 3.0 / k) + 0.5 * e.c, 6) AS score FROM e JOIN t a ON a.term = e.s JOIN t b ON b.term = e.o LEFT JOIN late ON late.s = e.s AND late.p = e.p AND late.o = e.o, my, d""")
def triplet_edge_scores(spark, sf_dir):
    said = tables.staged(_said(spark, sf_dir), "said")
    return KN.scored_triplet_edges(KN.triplet_edges(said), KN.triplet_terms(said)).select("subject", "predicate", "object", F.round("score", 6).alias("score"))


@query("triplet_events", f"WITH {SAID_SQL}, y AS (SELECT s, p, o, y, count(*) AS n FROM said GROUP BY ALL), e AS (SELECT s, p, o, min(paper) AS paper FROM said GROUP BY ALL) SELECT y.s AS subject, y.p AS predicate, y.o AS object, y.y AS year, n AS copies, CAST(n * n AS DOUBLE) AS weight, 'supports' AS polarity, paper AS paper_id FROM y JOIN e ON y.s = e.s AND y.p = e.p AND y.o = e.o")
def triplet_events(spark, sf_dir):
    rows = KN.event_rows(KN.triplet_edges(_said(spark, sf_dir)))
    return rows.groupBy("subject", "predicate", "object", "year", "polarity", "paper_id").agg(F.count(F.lit(1)).alias("copies"), F.sum("weight").alias("weight"))


@query("first_chunks", "SELECT doc_id, chunk FROM (SELECT doc_id, unnest(range(0, CAST(greatest(1, ceil(length(text) / 1200.0)) AS BIGINT))) AS chunk FROM documents) WHERE chunk < 16")
def first_chunks(spark, sf_dir):
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 1200).cast("int"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    return KN.first_chunks(chunks).select(F.col("paper_id").alias("doc_id"), F.col("pos").cast("long").alias("chunk"))


def _reviewed(spark, sf_dir):
    """Events as reviewed assertions: of every third the object, of every fifth the dates are corrected."""
    rows = E.triplets(table(spark, sf_dir, "events"))
    k, none = F.col("event_id"), F.lit(None).cast("string")
    fixed = {"corrected_subject": none, "corrected_predicate": F.lit(" "), "corrected_object": F.when(k % 3 == 0, "fixed"), "corrected_start_date": none, "corrected_end_date": F.when(k % 5 == 0, "2030"), "corrected_time_interval": F.when(k % 5 == 0, "2029")}
    return rows.select(F.col("subject").alias("source_id"), k.alias("pos"), "subject", "predicate", "object", F.when(k % 2 == 0, F.col("day")).alias("start_date"), none.alias("end_date"), *(v.cast("string").alias(n) for n, v in fixed.items()), F.lit("accepted").alias("verdict"), none.alias("rationale"), F.lit("{}").alias("evidence"))


REVIEWED_SQL = f"""{TRIPLETS_SQL}, f AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN day ELSE 'unknown' END AS a, 'u' AS x FROM triplets),
r AS (SELECT event_id, subject, '{{"subject":"' || subject || '","predicate":"' || predicate || '","object":"' || object || '","start_date":"' || a || '","end_date":"unknown"}}' AS old, '{{"subject":"' || subject || '","predicate":"' || predicate || '","object":"' || CASE WHEN event_id % 3 = 0 THEN 'fixed' ELSE object END || '","start_date":"' || CASE WHEN event_id % 5 = 0 THEN '2029' ELSE a END || '","end_date":"' || CASE WHEN event_id % 5 = 0 THEN '2030' ELSE 'unknown' END || '"}}' AS new FROM f)"""


@query("repair_pairs", f"WITH {REVIEWED_SQL} SELECT 'graph_pref:' || subject || ':' || event_id AS id, new AS chosen, old AS rejected FROM r WHERE event_id % 3 = 0 OR event_id % 5 = 0")
def repair_pairs(spark, sf_dir):
    return N.repair_pairs(_reviewed(spark, sf_dir)).drop("task_family")


@query("repair_records", f"WITH {REVIEWED_SQL} SELECT 'graph_repair:' || subject || ':' || event_id AS id, 3 AS n, new AS answer FROM r WHERE event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 2 = 0")
def repair_records(spark, sf_dir):
    return N.repair_records(_reviewed(spark, sf_dir)).select("id", F.size("messages").alias("n"), F.element_at("messages", -1)["content"].alias("answer"))


@query("time_and_caption_pairs", """SELECT 'temporal_pref:' || user_id || ':' || event_id AS id, 'temporal_preference' AS task_family FROM events WHERE event_id % 2 = 0 AND event_id % 3 = 0 UNION ALL SELECT 'mm_pref:' || user_id || ':' || event_id, 'mm_caption_preference' FROM events WHERE event_id % 2 = 0 AND event_id % 5 <> 0 UNION ALL SELECT 'temporal_fix:' || user_id || ':' || event_id, 'temporal_fix' FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'mm_review:' || user_id || ':' || event_id, 'mm_caption_fix' FROM events WHERE event_id % 2 = 0""")
def time_and_caption_pairs(spark, sf_dir):
    """Events as corrections: every second has one, every third says what was there before, every fifth caption stays."""
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("source_id"), k.alias("pos"), F.lit("a").alias("assertion_id"), k.alias("page"), F.lit("fix").alias("verdict"), F.lit(None).cast("string").alias("rationale"), F.when(k % 2 == 0, F.lit('{"start":"2020"}')).alias("corrected"), F.when(k % 3 == 0, F.lit('{"start":"2019"}')).otherwise(" ").alias("original"))
    captions = rows.withColumn("original", F.when(F.col("pos") % 5 == 0, F.col("corrected")).otherwise("other"))
    parts = [*N.time_records(rows), *N.caption_records(captions)]
    return reduce(DataFrame.union, (p.select("id", "task_family") for p in parts))


@query("step_samples", "SELECT conv_id AS doc, turn AS pos, 'Earlier steps:' || chr(10) || coalesce(string_agg('- ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || chr(10) || 'Claim: ' || text AS prompt FROM conversations")
def step_samples(spark, sf_dir):
    """Turns as the steps of a conversation."""
    steps = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.col("text").alias("claim"), F.col("role").alias("inference"))
    return N.step_samples(steps).select("doc", "pos", F.col("messages")[0]["content"].alias("prompt"))


@query("verdict_samples", f"WITH {TRIPLETS_SQL} SELECT CASE predicate WHEN 'purchase' THEN 'accepted' ELSE 'rejected' END AS expected_verdict, count(*) AS n FROM triplets WHERE predicate IN ('purchase', 'error') GROUP BY 1")
def verdict_samples(spark, sf_dir):
    rows = E.triplets(table(spark, sf_dir, "events")).withColumns({"doc": F.col("subject"), "pos": F.col("event_id"), "verdict": F.when(F.col("predicate") == "purchase", " Accepted").when(F.col("predicate") == "error", "rejected").otherwise("uncertain")})
    return N.verdict_samples(rows).groupBy("expected_verdict").agg(F.count(F.lit(1)).alias("n"))


@query("collected_refs", "WITH r AS (SELECT l_orderkey AS doc, 's' || l_suppkey AS ref, min(l_linenumber * 100000000 + l_suppkey) AS o FROM lineitem GROUP BY 1, 2), a AS (SELECT o_orderkey AS doc, 'c' || o_custkey AS ref, -1 AS o FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY o) - 1 AS INT) AS pos, ref FROM (SELECT * FROM r UNION ALL SELECT * FROM a)")
def collected_refs(spark, sf_dir):
    """The customer of an order, then the suppliers of its lines, each once."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: F.concat(F.lit(" s"), x["l_suppkey"].cast("string"))).alias("refs"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("main"))
    return N.collected_refs(lines.join(orders, "doc"), "doc", ["main", "refs"])


@query("final_ranking", """WITH r AS (SELECT p_partkey AS key, p_retailprice / 1000 AS score, CASE WHEN p_partkey % 3 = 0 THEN p_size / 50 END AS prediction FROM part), l AS (SELECT l_partkey AS key, l_discount * 10 AS strength, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_discount) AS rank FROM lineitem),
n AS (SELECT key, avg(strength) FILTER (rank <= 6) AS retrieval, count(*) FILTER (rank <= 20) AS ev FROM l GROUP BY 1), m AS (SELECT l_partkey AS key, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag = 'A') AS b FROM lineitem GROUP BY 1), x AS (SELECT key, sum(CASE WHEN rank % 2 = 0 THEN 0.25 ELSE 0 END) AS e FROM l WHERE rank <= 10 GROUP BY 1),
p AS (SELECT r.key, score, coalesce(prediction, 0) AS prediction, least(1.0, 0.2 * coalesce(a, 0) + 0.15 * coalesce(b, 0)) AS mm, coalesce(retrieval, 0) AS retrieval, CASE WHEN r.key % 2 = 0 THEN 0 ELSE -1 END + CASE WHEN coalesce(ev, 0) > 0 THEN 0 ELSE -1 END + least(0.5, 0.1 * coalesce(ev, 0)) + coalesce(e, 0) AS reward FROM r LEFT JOIN n ON r.key = n.key LEFT JOIN m ON r.key = m.key LEFT JOIN x ON r.key = x.key)
SELECT key, round(CAST(mm AS DOUBLE), 6) AS multimodal, round(CAST(reward AS DOUBLE), 6) AS reward, round(CAST(1.6 * score + 0.9 * prediction + 0.7 * mm + 0.6 * retrieval + reward AS DOUBLE), 6) AS final_score FROM p ORDER BY 1.6 * score + 0.9 * prediction + 0.7 * mm + 0.6 * retrieval + reward DESC, key LIMIT 30""")
def final_ranking(spark, sf_dir):
    """Parts as candidates, lines as their neighbours, matched triplets, pictures and citations."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), (F.col("p_retailprice") / 1000).alias("score"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") / 50).alias("prediction"), F.when(F.col("p_partkey") % 2 == 0, "2020-2022").otherwise(" ").alias("time_scope"))
    rank = F.row_number().over(W.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_discount"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), rank.alias("rank"), (F.col("l_discount") * 10).alias("strength"), "l_returnflag")
    evidence = lines.where("rank <= 20").select("key", F.col("rank").alias("place"), F.concat(F.lit("a"), F.when(F.col("rank") % 2 == 0, "|").otherwise("-"), F.lit("b")).alias("source_id"))
    overrides = spark.createDataFrame([("a|b", 1, 9.0), ("a|b", 2, 0.25), ("a-b", 1, 5.0)], "source_id string, pos int, weight double")
    out = H.ranked_records(rows, lines, lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"), evidence, overrides, 30)
    return out.select("key", *(F.round(c, 6).alias(c) for c in ("multimodal", "reward", "final_score")))


@query("indexed_search", f"WITH h AS ({_nearest_sql('cosine')}) SELECT h.query_id, h.vec_id, h.score, label AS payload FROM h JOIN embeddings e ON h.vec_id = e.vec_id")
def indexed_search(spark, sf_dir):
    """Vectors written as an index and searched there."""
    path = f"{tables.root(spark)}/lodestar-index-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "embeddings")
    VC.write_index(rows.select("vec_id", "embedding", F.col("label").alias("payload")), path)
    return VC.search_index(spark, path, rows.where("vec_id % 20 = 0").select("vec_id", "embedding"), 5).select("query_id", "vec_id", "score", "payload")


@query("compacted_json", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"a": {"b": "' || event_type || '"}, "l": [1]}' ELSE '{"l": [1]}' END AS compact, CASE WHEN event_id % 2 = 0 THEN 'a: b: ' || event_type || '; l: 1' ELSE 'l: 1' END AS text FROM events""")
def compacted_json(spark, sf_dir):
    """Nested values without what is empty in them, and as text."""
    inner = F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("").alias("b")))
    json = F.concat(F.lit('{"x": null, "y": [], "a": '), inner, F.lit(', "l": [null, 1, ""]}'))
    return table(spark, sf_dir, "events").select("event_id", X.compact_json(json).alias("compact"), X.text_of_json(json).alias("text"))


@query("ascii_slugs", "SELECT p_partkey, replace(lower(p_name), ' ', '-') || '-eu' || p_size AS slug FROM part")
def ascii_slugs(spark, sf_dir):
    name = F.concat(F.upper("p_name"), F.lit(" Éü°"), F.col("p_size").cast("string"), F.lit("!!"))
    return table(spark, sf_dir, "part").select("p_partkey", X.ascii_slug(name).alias("slug"))


@query("graph_answers", f"WITH {BASKET_SQL}, d AS (SELECT CAST(node AS VARCHAR) AS name, degree / ((SELECT count(*) FROM deg) - 1) AS value FROM deg ORDER BY degree DESC, node LIMIT 20) SELECT name, round(value, 6) AS value FROM d UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT (SELECT CAST(min(node) AS VARCHAR) FROM deg), (SELECT count(*) FROM deg)")
def graph_answers(spark, sf_dir):
    """The degree analysis, a count and the components of the parts bought together."""
    edges = tables.staged(_basket(spark, sf_dir), "basket")
    labels = {"Part": table(spark, sf_dir, "part")}
    parts = [G.answer(q, labels, edges) for q in ("degree", "count Part", "components")]
    return reduce(DataFrame.union, parts).select("name", F.round("value", 6).alias("value"))


@query("top_strengths", f"WITH {BASKET_SQL} SELECT CAST(row_number() OVER (ORDER BY strength DESC, node) AS INT) AS place, node, strength AS score FROM deg ORDER BY strength DESC, node LIMIT 15")
def top_strengths(spark, sf_dir):
    return G.top_nodes(G.degrees(_basket(spark, sf_dir)), "strength", 15)


@query("evidence_recall", "WITH g AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS s FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS c, l_suppkey AS s FROM lineitem WHERE l_quantity > 25) SELECT g.c AS case_id, count(*) AS n_gold, count(p.s) AS n_found, round(count(p.s) / count(*), 6) AS recall FROM g LEFT JOIN p ON g.c = p.c AND g.s = p.s GROUP BY 1")
def evidence_recall(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("source_id"), "l_quantity")
    return V.evidence_recall(lines.where("l_quantity > 25"), lines, "case_id").withColumn("recall", F.round("recall", 6))


@query("time_accuracy", f"WITH {TRIPLETS_SQL}, g AS (SELECT subject AS c, lower(predicate) || object AS k, min(day) AS d FROM triplets GROUP BY 1, 2), p AS (SELECT subject AS c, lower(predicate) || object AS k, min(day) AS d FROM triplets WHERE value > 20 GROUP BY 1, 2) SELECT g.c AS case_id, count(*) AS n, count(*) FILTER (g.d = p.d) AS same, round(count(*) FILTER (g.d = p.d) / count(*), 6) AS accuracy FROM g JOIN p ON g.c = p.c AND g.k = p.k GROUP BY 1")
def time_accuracy(spark, sf_dir):
    rows = E.triplets(table(spark, sf_dir, "events")).select(F.col("subject").alias("case_id"), F.lit("s").alias("subject"), "predicate", "object", F.col("day").alias("start"), F.lit("").alias("end"), "value")
    return V.time_accuracy(rows.where("value > 20"), rows, "case_id").withColumn("accuracy", F.round("accuracy", 6))


@query("filtered_hits", f"WITH h AS ({_nearest_sql('cosine', k=10)}), k AS (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, h.vec_id) AS r FROM h JOIN embeddings e ON h.vec_id = e.vec_id WHERE label % 2 = 0) SELECT query_id, vec_id, CAST(r AS INT) AS place FROM k WHERE r <= 5")
def filtered_hits(spark, sf_dir):
    """The ten nearest of each query, of which the first five of an even label stay."""
    kinds = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("kind"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    hits = VC.nearest(rows, rows.where("vec_id % 20 = 0"), 10)
    return VC.filtered_search(hits, kinds, "even", 5).select("query_id", "vec_id", "place")


@query("review_variants", """SELECT p_partkey AS rank, lower(p_name) || '|uses|' || lower(p_type) AS signature, round(p_retailprice / 7, 4) AS score, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 2 END AS n_evidence, CASE WHEN p_size % 2 = 0 THEN 'stable 2001-2003' ELSE 'predicted' END AS temporal_summary FROM part""")
def review_variants(spark, sf_dir):
    n, none = F.col("p_size"), F.lit(None)
    cite = lambda text: F.struct(F.lit("s").alias("source_id"), text.alias("snippet"))
    evidence = F.array(cite(F.lit("a")), cite(F.lit(" ")), cite(F.lit("a")), cite(F.when(n % 3 != 0, "b")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rank"), F.upper("p_name").alias("source"), F.lit(" Uses").alias("predicate"), F.col("p_type").alias("target"), F.lit("t").alias("title"), none.cast("string").alias("premise"), F.lit("m").alias("mechanism"), F.lit("").alias("time_scope"), (F.col("p_retailprice") / 7).alias("final_score"), evidence.alias("evidence"), F.when(n % 2 == 0, 2001).alias("first_seen"), F.when(n % 2 == 0, 2003).alias("last_seen"), F.when(n % 2 == 0, "stable").otherwise("predicted").alias("ordering"))
    v = F.col("variant")
    return S.review_variants(rows, "a", "System A").select("rank", "signature", v["score"].alias("score"), F.size(v["supporting_evidence"]).alias("n_evidence"), v["temporal_summary"].alias("temporal_summary"))


@query("payload_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def payload_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return S.records(S.payloads(rows, "c_custkey"), "c_custkey", "c_name string, c_acctbal double")


@query("keywords", f"WITH t AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\-]{{3,}}'), lambda t: NOT list_contains({STOP_SQL}, t)) AS t FROM benchmark), u AS (SELECT item_id, unnest(t) AS w, unnest(range(0, len(t))) AS pos FROM t), f AS (SELECT item_id, w, min(pos) AS pos FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS k FROM f) SELECT item_id, string_agg(w, ' ' ORDER BY pos) AS words FROM r WHERE k <= 5 GROUP BY 1")
def keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(S.keywords(F.col("text"), 5), " ").alias("words")).where("words <> ''")


@query("adapted_prompts", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Describe the figure: ' || p_name WHEN 1 THEN 'Compare ' || p_name ELSE p_name END AS prompt FROM part")
def adapted_prompts(spark, sf_dir):
    """The first rule that fits rewrites a prompt; others after it do not."""
    rules = [(r"^Draw\s+(.*)$", "Describe the figure: $1"), (r"^Weigh\s+(.*)$", "Compare $1"), ("figure", "never")]
    prompt = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Draw  "), "p_name")).when(F.col("p_size") % 3 == 1, F.concat(F.lit("Weigh "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", Q.rewritten(prompt, rules).alias("prompt"))


@query("page_locators", "SELECT p_partkey, 'p. ' || p_size AS own, CAST(least(p_size + 9, p_size + 5) - p_size + 1 AS INT) AS n_pages FROM part")
def page_locators(spark, sf_dir):
    """A range of ten pages is spelt out to six."""
    own = F.concat(F.lit("p. "), F.col("p_size").cast("string"))
    locator = F.concat(F.lit("see pp. "), F.col("p_size").cast("string"), F.lit("-"), (F.col("p_size") + 9).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", own.alias("own"), F.size(B.pages_of(locator)).alias("n_pages"))


@query("pdf_links", r"""SELECT page_id, len(list_filter(regexp_extract_all(html, 'href="([^"]+)"', 1), lambda h: contains(lower(h), 'pdf'))) AS n, 'http://x.org/a/p' || page_id || '.pdf' AS first FROM pages""")
def pdf_links(spark, sf_dir):
    """A citation tag in front of each page gives its first link."""
    html = F.concat(F.lit('<meta name="citation_pdf_url" content="p'), F.col("page_id").cast("string"), F.lit('.pdf">'), "html")
    found = P.pdf_links(html, F.lit("http://x.org/a/b"))
    return table(spark, sf_dir, "pages").select("page_id", (F.size(F.filter(found, lambda u: F.lower(u).contains("pdf"))) - 1).alias("n"), found[0].alias("first"))


def _folders(spark, sf_dir):
    """Conversations as paper folders of chunks and of pages."""
    path = f"{tables.root(spark)}/lodestar-papers-{uuid.uuid4().hex}"
    turns = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    chunks = turns.select(name.alias("paper_id"), F.concat_ws(":", name, F.col("turn").cast("string")).alias("chunk_id"), "text", F.lit("text").alias("modality"), F.col("turn").cast("int").alias("page"))
    papers = turns.select(name.alias("paper_id"), F.lit("t").alias("title")).distinct()
    K.write_papers(papers, path, "paper_id", chunks)
    pages = turns.where("role = 'assistant'").select(name.alias("paper_id"), F.col("turn").cast("int").alias("page"), F.col("role").alias("text"), F.lit(" ").alias("vlm_caption"), F.lit("|a|").alias("tables_md"))
    pages.withColumn("paper_dir", F.col("paper_id")).write.partitionBy("paper_dir").json(f"{path}/pages")
    return path


@query("paper_folders", "WITH b AS (SELECT conv_id, turn, text, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations WHERE trim(text) <> '') SELECT 'c' || conv_id AS paper_dir, 'c' || conv_id || ':' || turn AS chunk_id, substring(text, 1, CAST(900 - before AS BIGINT)) AS text FROM b WHERE before < 900")
def paper_folders(spark, sf_dir):
    """Chunks written into a folder per paper and read again, 900 letters of each paper."""
    path = _folders(spark, sf_dir)
    return P.processed_chunks(spark, f"{path}/chunks", 900, "paper_dir=*", "page").select("paper_dir", "chunk_id", "text")


@query("chunk_registry", "SELECT 'c' || conv_id || ':' || turn AS chunk_id, 'text' AS modality FROM conversations WHERE trim(text) <> '' UNION ALL SELECT 'c' || conv_id || ':page' || turn || s, m FROM conversations, (VALUES ('', 'page'), (':table', 'table')) v(s, m) WHERE role = 'assistant'")
def chunk_registry(spark, sf_dir):
    path = _folders(spark, sf_dir)
    return P.chunk_registry(spark, path, "chunks/paper_dir=*", "pages/paper_dir=*").select("chunk_id", "modality")


@query("page_texts", "SELECT 'c' || conv_id AS paper_dir, CAST(turn AS INT) AS page, 'assistant' || chr(10) || 'Tables: |a|' AS text FROM conversations WHERE role = 'assistant'")
def page_texts(spark, sf_dir):
    path = _folders(spark, sf_dir)
    return P.processed_pages(spark, f"{path}/pages", files="paper_dir=*").select("paper_dir", "page", "text")


@query("text_records", "WITH r AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations WHERE trim(text) <> '' GROUP BY 1) SELECT 'c' || conv_id AS paper_id, 't' AS title, t AS text FROM r")
def text_records(spark, sf_dir):
    """The whole text of each paper, its chunks in order."""
    path = _folders(spark, sf_dir)
    meta = spark.read.schema("paper_id string, title string, paper_dir string").json(f"{path}/meta").select(F.col("paper_id").alias("id"), "title", F.lit(None).cast("int").alias("year"), F.lit("").alias("abstract"), "paper_dir")
    chunks = P.processed_chunks(spark, f"{path}/chunks", files="paper_dir=*", order="page").withColumn("line", F.col("page"))
    return P.text_records(meta, chunks).select("paper_id", "title", "text")
