"""Queries that gather evidence, triggers and negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import evidence as V
from lodestar.operators import events as E
from lodestar.plans.event_queries import EDGES_SQL
from lodestar.plans.registry import query, table
from lodestar.plans.vector_queries import _nearest_sql, _search


@query("assets_near_turns", """WITH a AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant'), s AS (SELECT conv_id, turn FROM conversations WHERE role <> 'assistant'),
f AS (SELECT DISTINCT s.conv_id, s.turn, a.turn AS asset FROM s JOIN a ON s.conv_id = a.conv_id AND abs(s.turn - a.turn) <= 1),
r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM a)
SELECT conv_id * 1000 + turn AS source_id, conv_id * 1000 + asset AS asset_id, 'page' AS how FROM f
UNION ALL SELECT s.conv_id * 1000 + s.turn, r.conv_id * 1000 + r.turn, 'fallback' FROM s JOIN r ON s.conv_id = r.conv_id WHERE r.k <= 3 AND NOT EXISTS (SELECT 1 FROM f WHERE f.conv_id = s.conv_id AND f.turn = s.turn)""")
def assets_near_turns(spark, sf_dir):
    """Assistant turns as assets of the other turns of a conversation, pages being turns."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("ref"), F.col("turn").cast("int").alias("page"), "role")
    sources = rows.where("role <> 'assistant'").select(F.col("id").alias("source_id"), "ref", "page", F.lit("").alias("locator"))
    assets = rows.where("role = 'assistant'").select(F.col("id").alias("asset_id"), "ref", "page", F.lit("text").alias("kind"), F.lit(None).cast("string").alias("label"))
    return V.assets_for(sources, assets)


@query("edges_of_entities", f"""WITH {EDGES_SQL}, n AS (SELECT DISTINCT 'k' || json_extract_string(props, '$.k') AS entity FROM events WHERE event_type = 'purchase'), e AS (SELECT unnest([subject, object]) AS entity, * FROM edges)
SELECT entity, subject, predicate, object, CAST(rank AS INT) AS rank FROM (SELECT e.*, row_number() OVER (PARTITION BY e.entity ORDER BY total_count DESC, subject, predicate, object) AS rank FROM e JOIN n ON e.entity = n.entity) WHERE rank <= 5""")
def edges_of_entities(spark, sf_dir):
    rows = E.triplets(table(spark, sf_dir, "events"))
    edges = E.edge_counts(rows).select("subject", "predicate", "object", F.col("total_count").alias("confidence"), F.lit("current").alias("status"))
    entities = rows.where("predicate = 'purchase'").select(F.col("object").alias("entity"))
    return V.touching(edges, entities, 5).select("entity", "subject", "predicate", "object", "rank")


@query("triggered_vectors", f"WITH h AS ({_nearest_sql('cosine')}) SELECT vec_id AS candidate, max(score) AS score, string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY query_id) AS queries FROM h WHERE vec_id % 20 <> 0 GROUP BY vec_id ORDER BY score DESC, candidate LIMIT 20")
def triggered_vectors(spark, sf_dir):
    """The twenty best neighbours of the query vectors that are none themselves, with the queries that found them."""
    hits = _search(spark, sf_dir, "cosine").select(F.col("vec_id").alias("candidate"), F.col("query_id").alias("query"), "score")
    known = table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("candidate"))
    return V.triggered(hits, known, 20).withColumn("queries", F.array_join(F.transform("queries", lambda q: q.cast("string")), ","))


@query("hard_negatives", r"""WITH w AS (SELECT conv_id, turn, role, text, lag(text, 2) OVER o AS a, lag(text, 4) OVER o AS b FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
c AS (SELECT conv_id * 1000 + turn AS key, text AS chosen, unnest(['near', 'far']) AS kind, unnest([a, b]) AS rejected, unnest([0, 1]) AS pos FROM w WHERE role = 'assistant'),
h AS (SELECT *, list_distinct(regexp_extract_all(lower(chosen), '[\p{L}\p{N}_\-]+')) AS x, list_distinct(regexp_extract_all(lower(rejected), '[\p{L}\p{N}_\-]+')) AS y FROM c WHERE rejected IS NOT NULL AND rejected <> chosen)
SELECT key, kind, CASE WHEN len(x) > 0 AND len(y) > 0 THEN round(0.7 * len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) + 0.3 * least(len(x), len(y)) / greatest(len(x), len(y)), 4) ELSE 0 END AS hardness FROM h""")
def hard_negatives(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    text = lambda k: F.lag("text", k).over(w)
    candidates = F.filter(F.array(F.struct(F.lit("near").alias("kind"), text(2).alias("text")), F.struct(F.lit("far").alias("kind"), text(4).alias("text"))), lambda c: c["text"].isNotNull())
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "role", F.col("text").alias("chosen"), candidates.alias("candidates")).where("role = 'assistant'")
    return V.negatives(rows).select("key", "kind", "hardness")
