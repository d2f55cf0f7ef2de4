"""Queries over vectors: every vector whose id is divisible by 20 searches all others."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import vectors as V
from lodestar.plans.registry import query, table

K = 5
SCORES = {
    "cosine": "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))",
    "dot": "list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))",
    "l2": "-list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))",
    "l1": "-list_sum(list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), lambda z: abs(z[1] - z[2])))",
}


def _nearest_sql(metric: str, where: str = "TRUE", k: int = K) -> str:
    return f"SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, v.label, round({SCORES[metric]}, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= {k} AND {where}"


def _search(spark, sf_dir, metric, k=K):
    vectors = table(spark, sf_dir, "embeddings")
    return V.nearest(vectors, vectors.where("vec_id % 20 = 0"), k, metric)


@query("knn_cosine", _nearest_sql("cosine"))
def knn_cosine(spark, sf_dir):
    return _search(spark, sf_dir, "cosine")


@query("knn_dot", _nearest_sql("dot"))
def knn_dot(spark, sf_dir):
    return _search(spark, sf_dir, "dot")


@query("knn_l2", _nearest_sql("l2"))
def knn_l2(spark, sf_dir):
    return _search(spark, sf_dir, "l2")


@query("knn_l1", _nearest_sql("l1"))
def knn_l1(spark, sf_dir):
    return _search(spark, sf_dir, "l1")


@query("knn_filtered", f"WITH n AS (SELECT n.*, e.label FROM ({_nearest_sql('cosine', k=2 * K)}) n JOIN embeddings e ON n.vec_id = e.vec_id) SELECT query_id, vec_id, score, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM n WHERE label % 2 = 0) WHERE r <= {K}")
def knn_filtered(spark, sf_dir):
    """Twice as many neighbours are fetched, then filtered by label, then cut: fewer than five may be left."""
    from pyspark.sql import Window as W

    near = _search(spark, sf_dir, "cosine", 2 * K)
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    kept = near.join(labels, "vec_id").where("label % 2 = 0")
    again = kept.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where(F.col("r") <= K)
    return again.select("query_id", "vec_id", "score", F.col("r").alias("rank"))


@query("hybrid_fusion", f"WITH a AS ({_nearest_sql('cosine', k=10)}), b AS ({_nearest_sql('l1', k=10)}), f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.vec_id, b.vec_id) AS vec_id, round(coalesce(1.0 / (60 + a.rank), 0) + coalesce(1.0 / (60 + b.rank), 0), 9) AS score FROM a FULL JOIN b ON a.query_id = b.query_id AND a.vec_id = b.vec_id) SELECT query_id, vec_id, round(score * 1000, 4) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM f) WHERE rank <= {K}")
def hybrid_fusion(spark, sf_dir):
    out = V.fused(_search(spark, sf_dir, "cosine", 10), _search(spark, sf_dir, "l1", 10), K)
    return out.withColumn("score", F.round(F.col("score") * 1000, 4))


@query("vector_blend", "SELECT vec_id, round(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), list_slice(CAST(embedding AS DOUBLE[]), 1, 32)), lambda z: 0.7 * z[1] + 0.3 * coalesce(z[2], 0))), 4) AS total FROM embeddings")
def vector_blend(spark, sf_dir):
    mixed = V.blend(F.col("embedding"), F.slice("embedding", 1, 32))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(mixed, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("hashed_embeddings", f"""WITH t AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\-]+')) AS token FROM documents) GROUP BY ALL),
s AS (SELECT doc_id, CAST(('0x' || substring(md5(token), 1, 8)) AS BIGINT) % 384 AS slot, sum(CASE WHEN substring(md5(token), 9, 1) IN ('1','3','5','7','9','b','d','f') THEN -n ELSE n END) AS raw FROM t GROUP BY 1, 2)
SELECT doc_id, slot, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS value FROM s WHERE raw <> 0""")
def hashed_embeddings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), F.lit(0)).alias("words"))
    return V.hashed(docs, "doc_id", "words").withColumn("value", F.round("value", 6))
