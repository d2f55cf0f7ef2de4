"""Queries that build and audit training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import datasets as D
from lodestar.operators import evaluation as V
from lodestar.operators import filters as Q
from lodestar.plans.registry import query, table


@query("group_split", """WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), p AS (SELECT *, row_number() OVER (ORDER BY sha1('7:' || source)) AS rank, coalesce(sum(n) OVER (ORDER BY sha1('7:' || source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT count(*) FROM documents) AS total FROM s)
SELECT source, n, CASE WHEN (before < round(total * 0.15) OR rank = 1) AND before + n < total THEN 'eval' ELSE 'train' END AS split FROM p""")
def group_split(spark, sf_dir):
    return D.group_split(table(spark, sf_dir, "documents"), "source", 0.15, "7")


@query("stratified_split", """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha1('5:' || doc_id)) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, CASE WHEN n > 1 AND rn <= least(greatest(1, round_even(n * 0.2, 0)), n - 1) THEN 'eval' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, sf_dir):
    return D.stratified_split(table(spark, sf_dir, "documents"), "source", "doc_id", 0.2, "5")


@query("chat_rows", "SELECT conv_id, count(*) AS n_turns, arg_min(role, turn) AS first_role, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages FROM conversations GROUP BY conv_id")
def chat_rows(spark, sf_dir):
    return D.chat_rows(table(spark, sf_dir, "conversations"))


PAIRS_SQL = r"""w AS (SELECT conv_id, turn, role, text, lag(text) OVER o AS prompt, lag(role) OVER o AS asker, lag(text, 2) OVER o AS rejected, lag(role, 2) OVER o AS other FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, prompt, text AS chosen, rejected, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_\-]+')) AS a, list_distinct(regexp_extract_all(lower(rejected), '[\p{L}\p{N}_\-]+')) AS b FROM w WHERE role = 'assistant' AND asker = 'user' AND other = 'assistant')"""


@query("preference_pairs", f"WITH {PAIRS_SQL} SELECT conv_id, turn, prompt, chosen, rejected, CASE WHEN len(a) > 0 AND len(b) > 0 THEN round(0.7 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) + 0.3 * least(len(a), len(b)) / greatest(len(a), len(b)), 4) ELSE 0 END AS hardness FROM p")
def preference_pairs(spark, sf_dir):
    return D.preference_pairs(table(spark, sf_dir, "conversations"))


@query("content_dedup", "SELECT role, text, min(conv_id * 1000 + turn) AS first_pos, count(*) AS n FROM conversations GROUP BY role, text")
def content_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("key", D.content_key("role", "text"))
    return rows.groupBy("key").agg(F.first("role").alias("role"), F.first("text").alias("text"), F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_pos"), F.count(F.lit(1)).alias("n")).drop("key")


@query("previous_context", "SELECT conv_id, turn, count(text) OVER o AS n_before, coalesce(sum(length(text)) OVER o, 0) AS chars_before FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def previous_context(spark, sf_dir):
    return D.previous_context(table(spark, sf_dir, "conversations"))


@query("budgeted_prefix", "SELECT conv_id, turn, text FROM conversations QUALIFY sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) <= 500")
def budgeted_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return D.within_budget(rows, "conv_id", "turn", "text", 500)


@query("page_band_join", "SELECT a.conv_id, a.turn, count(*) AS n, sum(length(b.text)) AS chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 1 GROUP BY 1, 2")
def page_band_join(spark, sf_dir):
    """Rows with their neighbours within one place: an equality on the group and on the place that each may have."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    near = rows.select("conv_id", "text", F.explode(F.array(F.col("turn") - 1, F.col("turn"), F.col("turn") + 1)).alias("turn"))
    return rows.select("conv_id", "turn").join(near, ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("robust_scores", """WITH m AS (SELECT l_suppkey, median(l_extendedprice) AS mid, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT l.l_suppkey, median(abs(l_extendedprice - mid)) AS mad FROM lineitem l JOIN m ON l.l_suppkey = m.l_suppkey GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(tanh(CASE WHEN n > 1 THEN greatest(least((l_extendedprice - mid) / greatest(1.4826 * mad, 1e-4), 2.5), -2.5) / 1.5 ELSE l_extendedprice END), 6) AS z FROM lineitem l JOIN m ON l.l_suppkey = m.l_suppkey JOIN d ON l.l_suppkey = d.l_suppkey""")
def robust_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return D.robust_scores(rows, "l_suppkey", "l_extendedprice").select("l_orderkey", "l_linenumber", F.round("z", 6).alias("z"))


@query("reward_audit", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS std, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY 1, 2")
def reward_audit(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("g", F.struct("l_returnflag", "l_linestatus"))
    out = D.audit(rows, "g", "l_discount")
    return out.select("g.l_returnflag", "g.l_linestatus", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "low", "high")


@query("zero_spread_groups", "WITH g AS (SELECT l_orderkey, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1) SELECT count(*) AS n_groups, round(count(*) FILTER (s = 0) / count(*), 6) AS zero_share, round(avg(s), 6) AS mean_std FROM g")
def zero_spread_groups(spark, sf_dir):
    groups = D.audit(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity")
    return groups.agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.count_if(F.col("std") == 0) / F.count(F.lit(1)), 6).alias("zero_share"), F.round(F.avg("std"), 6).alias("mean_std"))


@query("duplicate_ids", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return D.duplicate_ids(table(spark, sf_dir, "conversations"), "conv_id")


@query("validation_errors", "SELECT doc_id, 'too short' AS error FROM documents WHERE length(text) < 50 UNION ALL SELECT doc_id, 'no end' FROM documents WHERE NOT regexp_matches(text, '[.!?|]$') UNION ALL SELECT doc_id, 'wrong length' FROM documents WHERE length(text) <> n_chars")
def validation_errors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return D.errors(docs, "doc_id", {"too short": F.length("text") < 50, "no end": ~F.col("text").rlike(r"[.!?|]\z"), "wrong length": F.length("text") != F.col("n_chars")})


@query("best_in_order", "WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS r FROM conversations) SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM r WHERE r <= 2 GROUP BY conv_id")
def best_in_order(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("pos"), F.length("text").alias("relevance"), F.col("turn").cast("string").alias("item"))
    return D.best_images(rows, 2).select(F.col("key").alias("conv_id"), F.array_join("items", ",").alias("turns"))


@query("reward_ready", "SELECT lang, count(*) AS n, count(quality) AS ready, count(quality) AS with_quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def reward_ready(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return Q.target_coverage(docs, "lang", ["quality"])


@query("agreement", """WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tn, count(*) AS n FROM labels),
k AS (SELECT *, (tp + tn) / n AS po, ((tp + fp) / n) * ((tp + fn) / n) + ((fn + tn) / n) * ((fp + tn) / n) AS pe FROM c)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1, round(po, 6) AS accuracy, round((po - pe) / (1 - pe), 6) AS kappa FROM k""")
def agreement(spark, sf_dir):
    """"Not toxic" as a prediction of quality."""
    rows = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("good"), (F.col("toxic") == 0).alias("clean"))
    out = V.agreement(rows, "clean", "good")
    return out.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "kappa")))
