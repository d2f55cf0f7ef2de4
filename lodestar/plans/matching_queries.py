"""Queries that merge, pair and resolve rows, rank hypotheses and extract triplets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import extraction as X
from lodestar.operators import filters as Q
from lodestar.operators import hypotheses as H
from lodestar.operators import knowledge as G
from lodestar.operators import matching as M
from lodestar.plans.knowledge_queries import SCORED_SQL, _found
from lodestar.plans.registry import query, table


@query("federated_merge", """WITH c AS (SELECT c_nationkey AS key, max(c_acctbal) AS bal, count(*) AS n, min(c_name) AS name FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS key, max(s_acctbal) AS bal, count(*) AS n, min(s_name) AS name FROM supplier GROUP BY 1)
SELECT coalesce(c.key, s.key) AS key, coalesce(c.name, s.name) AS name, greatest(c.bal, s.bal) AS bal, CASE WHEN c.key IS NULL OR s.key IS NULL THEN 1 ELSE 2 END AS n_sources FROM c FULL JOIN s ON c.key = s.key""")
def federated_merge(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.max("c_acctbal").alias("bal"), F.min("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("key")).agg(F.max("s_acctbal").alias("bal"), F.min("s_name").alias("name"))
    return M.merged([c, s], "key", prefer=["name"], largest=["bal"])


@query("rank_pairing", """WITH p AS (SELECT p_partkey, p_brand AS g, p_type AS sig, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r, p_partkey % 2 AS side FROM part),
a AS (SELECT g, sig, r AS lrank, row_number() OVER (PARTITION BY g, sig ORDER BY r) AS k FROM p WHERE side = 0), b AS (SELECT g, sig, r AS rrank, row_number() OVER (PARTITION BY g, sig ORDER BY r) AS k FROM p WHERE side = 1),
f AS (SELECT coalesce(a.g, b.g) AS g, lrank, rrank FROM a FULL JOIN b ON a.g = b.g AND a.sig = b.sig AND a.k = b.k),
x AS (SELECT g, lrank, row_number() OVER (PARTITION BY g ORDER BY lrank) AS place FROM f WHERE rrank IS NULL), y AS (SELECT g, rrank, row_number() OVER (PARTITION BY g ORDER BY rrank) AS place FROM f WHERE lrank IS NULL)
SELECT g, lrank, rrank, 'signature' AS how FROM f WHERE lrank IS NOT NULL AND rrank IS NOT NULL UNION ALL SELECT x.g, lrank, rrank, 'order' FROM x JOIN y ON x.g = y.g AND x.place = y.place""")
def rank_pairing(spark, sf_dir):
    """Parts with even against parts with odd keys within a brand, signature the type."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("g"), F.col("p_type").alias("sig"), F.row_number().over(W.partitionBy("p_brand").orderBy("p_retailprice", "p_partkey")).alias("r"))
    side = F.col("p_partkey") % 2
    return M.paired_by_rank(parts.where(side == 0), parts.where(side == 1), "g", "sig", "r")


TOK = r"list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type || ' ' || p_brand), '[\p{L}\p{N}_#\-]+'))"


@query("similar_part_names", rf"""WITH t AS (SELECT p_partkey AS k, {TOK} AS x FROM part), p AS (SELECT a.k AS a, b.k AS b, len(list_intersect(a.x, b.x)) AS s, len(list_distinct(list_concat(a.x, b.x))) AS u, least(len(a.x), len(b.x)) AS m FROM t a JOIN t b ON a.k < b.k)
SELECT a, b, round(greatest(s / u, 0.9 * s / m), 6) AS similarity FROM p WHERE greatest(s / u, 0.9 * s / m) >= 0.85""")
def similar_part_names(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")), F.lit(r"[\p{L}\p{N}_#\-]+"), F.lit(0))).alias("x"))
    return M.token_pairs(parts, "k", "x", 0.85).withColumn("similarity", F.round("similarity", 6))


@query("entity_merge", "WITH f AS (SELECT label, min(vec_id) AS k, count(*) AS n FROM embeddings GROUP BY label) SELECT e.vec_id, f.k AS canonical FROM embeddings e JOIN f ON e.label = f.label WHERE f.n > 1")
def entity_merge(spark, sf_dir):
    """Vectors of one label are linked to the first of them; all take the canonical member of their group."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    first = rows.groupBy("label").agg(F.min("vec_id").alias("a"))
    pairs = rows.join(first, "label").select("a", F.col("vec_id").alias("b")).where("a <> b")
    return M.canonical_names(pairs, rows.select("vec_id", F.lit(1).alias("n")), "vec_id")


@query("title_ratio")
def title_ratio(spark, sf_dir):
    """Matching-block ratio of part names to the name of the part before them in the same brand."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lag("p_name").over(W.partitionBy("p_brand").orderBy("p_partkey")).alias("other"))
    return parts.select("p_partkey", F.round(M.sequence_ratio("p_name", "other"), 6).alias("ratio"))


@query("hypothesis_candidates", f"""WITH {SCORED_SQL}, s AS (SELECT source, target, total_count, round(trend, 6) AS trend, round(log_count + 0.75 * pmi + 1.25 * trend + 0.2, 6) AS score FROM feat),
e AS (SELECT source, target, score, trend, 'emerging_edge' AS kind FROM s WHERE total_count >= 2 AND trend > 0.05 ORDER BY score DESC, source, target LIMIT 10), t AS (SELECT source, target, score, trend, 'top_edge' AS kind FROM s WHERE NOT EXISTS (SELECT 1 FROM e) ORDER BY score DESC, source, target LIMIT 10)
SELECT source, target, score, trend, kind, source || ' may shape ' || target AS title, CAST(least(greatest(round_even(5 + 10 * trend, 0), 3), 9) AS INT) AS confidence FROM (SELECT * FROM e UNION ALL SELECT * FROM t)""")
def hypothesis_candidates(spark, sf_dir):
    edges = G.scored_edges(*_found(spark, sf_dir)).select("source", "target", "total_count", F.round("trend", 6).alias("trend"), F.round("score", 6).alias("score"))
    return H.drafted(H.candidates(edges, 10))


@query("hypothesis_ranking", f"""WITH {SCORED_SQL}, n AS (SELECT node, avg(score) AS near FROM (SELECT source AS node, log_count AS score FROM feat UNION ALL SELECT target, log_count FROM feat) GROUP BY node)
SELECT source, target, round(1.6 * log_count + 0.9 * pmi + 0.6 * (a.near + b.near) / 2 + least(0.5, 0.1 * papers), 6) AS final_score FROM feat JOIN n a ON source = a.node JOIN n b ON target = b.node ORDER BY final_score DESC, source, target LIMIT 20""")
def hypothesis_ranking(spark, sf_dir):
    """The twenty edges of the best final score: candidate, prediction, retrieval (strength around both ends) and reward."""
    edges = G.scored_edges(*_found(spark, sf_dir))
    near = edges.select(F.explode(F.array("source", "target")).alias("node"), "log_count").groupBy("node").agg(F.avg("log_count").alias("near"))
    out = edges.join(near.select(F.col("node").alias("source"), F.col("near").alias("a")), "source").join(near.select(F.col("node").alias("target"), F.col("near").alias("b")), "target")
    score = H.final_score(F.col("log_count"), F.col("pmi"), F.lit(0.0), (F.col("a") + F.col("b")) / 2, H.reward(F.lit(True), F.col("papers"), F.lit(0.0)))
    return out.select("source", "target", F.round(score, 6).alias("final_score")).orderBy(F.desc("final_score"), "source", "target").limit(20)


@query("citations", """WITH r AS (SELECT conv_id, role AS source_id, text AS snippet, min((CASE role WHEN 'assistant' THEN 0 ELSE 1 END) * 1000 + turn) AS first_at FROM conversations GROUP BY ALL)
SELECT conv_id, CAST(place AS INT) AS place, source_id, substring(snippet, 1, 220) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first_at, source_id) AS place FROM r) WHERE place <= 6""")
def citations(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("source_id"), F.col("text").alias("snippet"), F.when(F.col("role") == "assistant", 0).otherwise(1).alias("priority"), F.col("turn").alias("pos"))
    return H.citations(rows, "conv_id")


@query("json_repair", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_repair(spark, sf_dir):
    """Properties wrapped in a code fence and cut words come back as JSON."""
    broken = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n``` done"))
    rows = table(spark, sf_dir, "events").select("event_id", X.repair_json(broken).alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.k").cast("int").alias("k"))


@query("modality_of_lines", r"SELECT page_id, CASE WHEN regexp_matches(lower(html), '\btab(le|\.)') THEN 'table' WHEN regexp_matches(lower(html), '\bfig(ure|\.)') THEN 'figure' WHEN regexp_matches(lower(html), '\b(eq(uation|\.)|formula)') THEN 'formula' ELSE 'text' END AS modality FROM pages")
def modality_of_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.modality("html").alias("modality"))


@query("exclusion_split", r"SELECT doc_id, CASE WHEN 2015 + doc_id % 10 > 2022 OR contains(source || ' ' || lower(text), 'src1') OR contains(source || ' ' || lower(text), 'src7') OR contains(lower(text), 'reserved') THEN 'excluded' ELSE 'kept' END AS part FROM documents")
def exclusion_split(spark, sf_dir):
    """Documents as papers: source as identifier, text as title, year by id."""
    docs = table(spark, sf_dir, "documents")
    rules = Q.exclusion_rules({"task2_exclusions": {"source_refs": ["src1", "src7"], "title_contains": ["reserved"], "max_year": 2022}})
    out = Q.excluded(rules, F.array("source"), F.array("text"), F.array().cast("array<string>"), F.lit(2015) + F.col("doc_id") % 10)
    return docs.select("doc_id", F.when(out, "excluded").otherwise("kept").alias("part"))


@query("benchmark_precision", r"""WITH d AS (SELECT DISTINCT lang, t FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_\-]{3,}')) AS t FROM documents)), b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_\-]{3,}')) AS t FROM benchmark),
m AS (SELECT lang, item_id, count(*) AS hit FROM d JOIN b ON d.t = b.t GROUP BY ALL), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)
SELECT lang, m.item_id, hit, round(hit / n, 6) AS recall FROM m JOIN n ON m.item_id = n.item_id""")
def benchmark_precision(spark, sf_dir):
    """Share of the tokens of each benchmark item that occur in the documents of a language."""
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit(T.TOKEN), F.lit(0)))
    b = table(spark, sf_dir, "benchmark").select("item_id", words("text").alias("t")).distinct()
    d = table(spark, sf_dir, "documents").select("lang", words("text").alias("t")).distinct()
    n = b.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    hits = d.join(b, "t").groupBy("lang", "item_id").agg(F.count(F.lit(1)).alias("hit"))
    return hits.join(n, "item_id").select("lang", "item_id", "hit", F.round(F.col("hit") / F.col("n"), 6).alias("recall"))


@query("scorer_training")
def scorer_training(spark, sf_dir):
    """One row per feature with its fitted weight: quality by length and toxicity."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.log1p("n_chars").alias("size")).join(table(spark, sf_dir, "labels"), "doc_id").select("size", F.col("toxic").cast("double").alias("toxic"), F.col("quality").cast("double").alias("quality"))
    bias, weights = X.train_scorer(rows, ["size", "toxic"], "quality")
    return spark.createDataFrame([("bias", bias), *zip(["size", "toxic"], weights, strict=True)], "feature string, weight double")
