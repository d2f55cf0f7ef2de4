"""Queries over rewards, validators, preference targets, images, resolution of papers and captured replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import resolution as S
from lodestar.operators import rewards as W
from lodestar.operators import training as N
from lodestar.operators import validators as V
from lodestar.plans.registry import query, table
from lodestar.sources import papers as P
from lodestar.sources import sinks as K

FAMILIES = ("assertion_review_rl", "mm_review_rl", "temporal_fix_rl", "trajectory_reasoning_rl", "image_label_rl")


def _pick(values, column, n):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (column % n + 1).cast("int"))


@query("verdict_rewards", """WITH p AS (SELECT p_partkey, p_partkey % 5 AS f, p_size % 6 AS form FROM part)
SELECT p_partkey, CAST(CASE WHEN f >= 3 THEN 0.0 ELSE CASE form WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN -0.55 WHEN 3 THEN 0.35 WHEN 4 THEN -0.75 ELSE -0.9 END END AS DOUBLE) AS override_match,
CAST(CASE WHEN f = 4 THEN 0.0 WHEN form = 3 THEN -0.5 WHEN form = 4 THEN -0.5 WHEN f <= 1 THEN CASE WHEN form IN (0, 2, 5) THEN 1.0 ELSE -0.25 END WHEN f = 2 THEN 0.0 ELSE -0.25 END AS DOUBLE) AS evidence_presence,
CAST(CASE WHEN form IN (3, 4) THEN NULL WHEN f <= 1 AND form <> 5 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS schema_validity FROM p""")
def verdict_rewards(spark, sf_dir):
    """Answers with the verdict and a reason, with the verdict, with another one, cut short, empty of it, and without one."""
    k, form = F.col("p_partkey"), F.col("p_size") % 6
    answers = ('{"verdict": "Accepted", "rationale": "seen"}', '```json\n{"verdict": "correct"}\n```', '{"verdict": "wrong", "rationale": "no"}', 'I would accept, {"verd', "nothing to say", '{"rationale": "x", "other": 1}')
    rows = table(spark, sf_dir, "part").select("p_partkey", _pick(FAMILIES, k, 5).alias("family"), _pick(answers, F.col("p_size"), 6).alias("text"), form.alias("form"))
    text, family = F.col("text"), F.col("family")
    schema = F.when(~F.col("form").isin(3, 4), W.schema_validity(text, family))
    return rows.select("p_partkey", F.round(W.override_match(text, F.lit("accept"), family), 6).alias("override_match"), F.round(W.evidence_presence(text, family), 6).alias("evidence_presence"), schema.alias("schema_validity"))


@query("partial_rewards", """WITH p AS (SELECT p_partkey, p_partkey % 5 AS f, p_size % 5 AS form FROM part)
SELECT p_partkey, round(CAST(CASE form WHEN 0 THEN -1.0 WHEN 1 THEN CASE WHEN f <= 1 THEN -1.0 + 0.15 + 0.05 + 0.05 + 0.15 ELSE -1.0 + 0.15 + 0.05 + 0.05 END
  WHEN 2 THEN CASE WHEN f <= 2 THEN -0.9 ELSE -1.0 END WHEN 3 THEN CASE WHEN f = 2 THEN -1.0 + 0.35 + 0.30 WHEN f = 4 THEN -0.65 ELSE -0.65 END ELSE CASE WHEN f = 4 THEN -0.85 ELSE -1.0 END END AS DOUBLE), 6) AS progress FROM p""")
def partial_rewards(spark, sf_dir):
    """What cut answers are worth: nothing, a key begun, a verdict in words, braces with dates, a bare key."""
    texts = ("  ", '{"verdict": "maybe', "accept it", '{"start_date": 1, "end_date": }', "label")
    rows = table(spark, sf_dir, "part").select("p_partkey", _pick(FAMILIES, F.col("p_partkey"), 5).alias("family"), _pick(texts, F.col("p_size"), 5).alias("text"))
    return rows.select("p_partkey", F.round(W.partial_progress(F.col("text"), F.col("family")), 6).alias("progress"))


@query("temporal_rewards", """WITH o AS (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, o_custkey % 4 AS form FROM orders)
SELECT o_orderkey, CAST(CASE form WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 ELSE -1.0 END AS DOUBLE) AS consistency FROM o""")
def temporal_rewards(spark, sf_dir):
    """Dates given alike, one of two, none, and an answer that is no JSON; what the reference does not know is not asked for."""
    year = F.date_format("o_orderdate", "yyyy")
    answer = lambda start, end: F.to_json(F.struct(F.struct(start.alias("start_date"), end.alias("end_date")).alias("corrected_temporal")))
    form, no = F.col("o_custkey") % 4, F.lit("1066")
    text = F.when(form == 0, answer(year, F.concat(F.lit(" "), year))).when(form == 1, answer(year, no)).when(form == 2, answer(no, no)).otherwise("no dates")
    reference = F.to_json(F.struct(year.alias("start_date"), year.alias("end_date"), F.lit("unknown").alias("valid_from"), F.lit("").alias("time_source")))
    return table(spark, sf_dir, "orders").select("o_orderkey", W.temporal_consistency(text, reference, F.lit("temporal_fix_rl")).alias("consistency"))


@query("graph_rewards", """WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem), k AS (SELECT l_orderkey, count(DISTINCT l_partkey) FILTER (l_quantity <= 30) AS got, count(DISTINCT l_partkey) FILTER (l_quantity >= 10) AS want, (SELECT count(*) FROM (SELECT l_partkey FROM l a WHERE a.l_orderkey = l.l_orderkey AND l_quantity <= 30 INTERSECT SELECT l_partkey FROM l b WHERE b.l_orderkey = l.l_orderkey AND l_quantity >= 10)) AS both_n FROM l GROUP BY l_orderkey)
SELECT l_orderkey, round(CASE WHEN got = 0 THEN CASE WHEN want > 0 THEN -1.0 ELSE 0.0 END WHEN want = 0 THEN -0.25 ELSE CAST(2.0 * (2.0 * both_n / (got + want)) - 1 AS DOUBLE) END, 6) AS consistency FROM k""")
def graph_rewards(spark, sf_dir):
    """Lines of up to 30 pieces as an answer's assertions, those of 10 and more as the reference's."""
    one = F.struct(F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("subject"), F.lit("holds").alias("predicate"), F.col("l_partkey").cast("string").alias("object"))
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_quantity") <= 30, one)).alias("got"), F.collect_list(F.when(F.col("l_quantity") >= 10, one)).alias("want"))
    answer, reference = F.to_json(F.struct(F.col("got").alias("extracted_assertions"))), F.to_json("want")
    return docs.select("l_orderkey", F.round(W.graph_consistency(answer, reference, F.lit("trajectory_reasoning_rl")), 6).alias("consistency"))


@query("label_rewards", "SELECT p_partkey, CAST(CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE -1.0 END AS DOUBLE) AS reward FROM part")
def label_rewards(spark, sf_dir):
    answer = F.when(F.col("p_size") % 3 == 0, F.to_json(F.struct(F.lower("p_type").alias("label")))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("it is "), "p_type", F.lit(" I think"))).otherwise("none of these")
    return table(spark, sf_dir, "part").select("p_partkey", W.label_match(answer, F.col("p_type"), F.lit("image_label_rl")).alias("reward"))


@query("target_pairs", r"""WITH p AS (SELECT p_partkey, p_partkey % 5 AS f, p_size, p_type FROM part), a AS (SELECT p_partkey, f, CASE f WHEN 0 THEN '{"verdict":"' || CASE WHEN p_size % 2 = 0 THEN 'accept' ELSE 'reject' END || '","rationale":"' || p_type || '"}' WHEN 1 THEN '{"mm_verdict":"' || CASE WHEN p_size % 2 = 0 THEN 'accept' ELSE 'reject' END || '","rationale":"' || p_type || '"}' WHEN 2 THEN '{"start_date":"' || (1990 + p_size) || '"}' WHEN 3 THEN '{"inference":"supported","next_question":"verify remaining evidence","extracted_assertions":"[]"}' ELSE '{"label":"' || p_type || '"}' END AS chosen FROM p)
SELECT 'dpo-grpo:' || p_partkey AS id, ['assertion_review', 'mm_review', 'temporal_fix', 'trajectory_reasoning', 'image_label'][f + 1] AS task_family, chosen FROM a""")
def target_pairs(spark, sf_dir):
    """A preference pair for each family's target."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), _pick(FAMILIES, k, 5).alias("task_family"), F.when(F.col("p_size") % 2 == 0, "Accepted").otherwise("invalid").alias("expected_verdict"), F.col("p_type").alias("rationale"), F.concat(F.lit('{"start_date":"'), (F.col("p_size") + 1990).cast("string"), F.lit('"}')).alias("reference_temporal"), F.lit("[]").alias("reference_assertions"), F.col("p_type").alias("reference_label"), F.lit(None).cast("string").alias("rejected"))
    return N.target_pairs(rows).select("id", "task_family", "chosen")


@query("label_records", """WITH p AS (SELECT p_partkey, p_type, p_size FROM part WHERE p_size % 4 <> 0), t AS (SELECT p_partkey AS id, unnest(['sft', 'grpo']) AS task, p_type, p_size FROM p)
SELECT id, task, CASE task WHEN 'sft' THEN 2 ELSE 1 END AS n_messages, CASE task WHEN 'sft' THEN '{"label":"' || p_type || '","label_id":' || p_size || '}' ELSE 'Which is it?' END AS last FROM t""")
def label_records(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("Which is it?").alias("prompt"), F.when(F.col("p_size") % 4 != 0, F.col("p_type")).alias("label"), F.col("p_size").alias("label_id"))
    return N.label_records(rows).select("id", "task", F.size("messages").alias("n_messages"), F.element_at("messages", -1)["content"].alias("last"))


def _image_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: F.concat(F.lit("img"), (x["l_suppkey"] % 5).cast("string"))).alias("images"))
    return lines.withColumns({"image": F.lit(None).cast("string"), "task_family": _pick(FAMILIES, F.col("id"), 5), "metadata": F.when(F.col("id") % 3 == 0, F.create_map(F.lit("expected_verdict"), F.lit("accept"))).otherwise(F.expr("CAST(map() AS map<string,string>)"))})


IMAGES_SQL = "i AS (SELECT l_orderkey AS id, 'img' || (l_suppkey % 5) AS image, min(l_linenumber * 100000000 + l_suppkey) AS pos FROM lineitem GROUP BY 1, 2), n AS (SELECT l_orderkey AS id, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT id, image, row_number() OVER (PARTITION BY id ORDER BY pos) AS place FROM i)"


@query("capped_images", f"WITH {IMAGES_SQL} SELECT id, string_agg(image, ',' ORDER BY place) AS images, arg_min(image, place) AS image FROM r WHERE place <= 2 GROUP BY id")
def capped_images(spark, sf_dir):
    return N.with_images(_image_rows(spark, sf_dir), 2).select("id", F.array_join("images", ",").alias("images"), "image")


@query("export_counters", f"WITH {IMAGES_SQL}, k AS (SELECT id, least(2, count(*)) AS kept FROM r GROUP BY id) SELECT count(*) AS rows, count(*) AS with_images, CAST(sum(n) AS BIGINT) AS refs_before, CAST(sum(kept) AS BIGINT) AS refs_after, count(*) FILTER (n > kept) AS truncated, count(DISTINCT n.id % 5) AS families, 0 AS duplicate_ids FROM n JOIN k ON n.id = k.id")
def export_counters(spark, sf_dir):
    return N.normalised_rows(_image_rows(spark, sf_dir), 2)[1]


@query("ready_rows", "SELECT id % 5 AS family, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem) WHERE id % 5 > 1 OR id % 3 = 0 GROUP BY 1")
def ready_rows(spark, sf_dir):
    """Rows of the review families that name an expected verdict in their metadata, and all of the others."""
    rows = N.ready_rows(_image_rows(spark, sf_dir), "task_family", {f: ["expected_verdict", "reference_verdict"] for f in FAMILIES[:2]})
    return rows.groupBy((F.col("id") % 5).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("aligned_messages", "SELECT p_partkey, p_size % 4 AS n_images, 1 + p_size % 4 AS n_blocks FROM part")
def aligned_messages(spark, sf_dir):
    """A turn with two image blocks and a text is given no, one, two or three images."""
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), F.lit(text).cast("string").alias("text"))
    messages = F.array(F.struct(F.lit("user").alias("role"), F.array(block("image", None), block("text", "look"), block("image", None)).alias("content")))
    out = N.aligned_messages(messages, F.col("p_size") % 4)
    blocks = F.flatten(F.transform(out, lambda m: m["content"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.filter(blocks, lambda b: b["type"] == "image")).alias("n_images"), F.size(blocks).alias("n_blocks"))


@query("manifest_stats", "SELECT (SELECT count(*) FROM orders) AS cases, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS records, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS without_images, (SELECT count(DISTINCT o_orderpriority) FROM orders) AS manifests, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F') AS flat, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 2 = 0) AS rationales")
def manifest_stats(spark, sf_dir):
    """Orders as cases of manifests by priority, lines as their images."""
    images = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.col("l_linenumber").cast("string")).alias("images"))
    orders = table(spark, sf_dir, "orders").join(images, "o_orderkey", "left")
    cases = orders.select(F.col("o_orderpriority").alias("manifest"), F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("paper_id"), F.coalesce("images", F.array().cast("array<string>")).alias("images"), F.when(F.col("o_orderstatus") != "F", "{}").otherwise(" ").alias("reference"), F.array(F.when(F.col("o_custkey") % 2 == 0, "because").otherwise("")).alias("rationales"))
    out = N.manifest_relations(cases)
    return out["stats"].crossJoin(out["flat"].agg(F.count(F.lit(1)).alias("flat"))).crossJoin(out["rationales"].agg(F.count(F.lit(1)).alias("rationales")))


@query("image_caps", "SELECT p_partkey, CAST(greatest(1, least(6, 1 + ceil(0.6 * (p_size % 10)) + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END)) AS INT) AS cap FROM part")
def image_caps(spark, sf_dir):
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", N.image_cap(n % 10, n % 2 == 0, n % 3 == 0, 6).alias("cap"))


@query("model_requests", "SELECT p_partkey, p_size % 4 <> 0 AND p_size % 5 <> 0 AND NOT (p_partkey % 3 = 1 AND p_size % 2 = 0) AND (p_partkey % 3 <> 2 OR p_size % 2 = 1) AS wanted FROM part")
def model_requests(spark, sf_dir):
    """Chunks that are pages, tables or text, with or without text, image and stored reply."""
    k, n = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", N.needs_model(_pick(("page", "Table", "text"), k, 3), F.when(n % 2 == 0, "words"), F.when(n % 4 != 0, "i.png"), n % 5 == 0).alias("wanted"))


@query("charge_steps", "SELECT l_orderkey AS profile, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_discount, l_quantity) - 1 AS INT) AS pos, round(l_discount / l_quantity * 3600, 6) AS seconds FROM lineitem")
def charge_steps(spark, sf_dir):
    """Lines as stages: the discount as the share to charge, the quantity as the rate."""
    stage = F.struct(F.lit(0.0).alias("soc_from"), F.col("l_discount").alias("soc_to"), F.col("l_quantity").alias("c_rate"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("profile")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", stage.alias("s")))), lambda x: x["s"]).alias("stages"))
    return N.charge_steps(rows).select("profile", "pos", F.round("seconds", 6).alias("seconds"))


@query("cost_estimates", "SELECT p_partkey, round(p_size * p_retailprice, 2) AS compute_cost, round(p_size * p_retailprice + 100, 2) AS total, p_size * p_retailprice + 100 <= 20000 AS fits FROM part")
def cost_estimates(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("hours"), F.col("p_retailprice").alias("price"), F.lit(20000.0).alias("budget"), F.lit(100.0).alias("reserve"))
    return N.cost_estimates(rows).select("p_partkey", "compute_cost", "total", "fits")


# -- validators -------------------------------------------------------------------


def _kinds(docs: DataFrame, errors) -> DataFrame:
    """(error, n): messages without their numbers, counted."""
    return docs.select(F.explode(errors).alias("e")).groupBy(F.regexp_replace("e", "[0-9]+", "#").alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("trajectory_errors", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS step, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
e AS (SELECT l_orderkey, step, n, step AS a, CAST(l_suppkey % 9 AS INT) AS b FROM l), u AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, a, b) AS same FROM e WHERE a <> b AND b BETWEEN 1 AND n),
m AS (SELECT 'domain required' AS error FROM (SELECT DISTINCT l_orderkey FROM l) WHERE l_orderkey % 7 = 0
UNION ALL SELECT 'step #: missing claim' FROM l WHERE l_quantity < 5 UNION ALL SELECT 'step #: missing conditions' FROM l WHERE l_discount = 0 UNION ALL SELECT 'step #: missing next_question' FROM l WHERE l_returnflag = 'R'
UNION ALL SELECT 'step #: missing sources[]' FROM l WHERE l_orderkey % 2 = 0 AND l_linenumber = 1 UNION ALL SELECT 'step #: source #: invalid type' FROM l WHERE l_orderkey % 2 = 0 AND l_linenumber <> 1 AND l_linenumber % 3 = 0
UNION ALL SELECT 'step #: source #: source required' FROM l WHERE l_orderkey % 2 = 0 AND l_linenumber <> 1 AND l_tax = 0
UNION ALL SELECT 'edge #: self-loop is not allowed' FROM e WHERE a = b UNION ALL SELECT 'edge #: out of range' FROM e WHERE a <> b AND NOT b BETWEEN 1 AND n)
SELECT error, count(*) AS n FROM m GROUP BY error""")
def trajectory_errors(spark, sf_dir):
    """Orders as trajectories: lines as steps with one source each, an edge from each step to the one that its supplier says."""
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag")))
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ordered.alias("l"))
    none = F.lit("")
    kind = lambda x: F.when(x["l_linenumber"] % 3 == 0, "sound").when(x["l_linenumber"] % 3 == 1, "Figure").otherwise("table")
    source = lambda x: F.struct(kind(x).alias("type"), F.when(x["l_tax"] == 0, none).otherwise("s").alias("source"), F.lit("said").alias("snippet_or_summary"))
    steps = F.transform("l", lambda x: F.struct(F.when(x["l_quantity"] < 5, none).otherwise("c").alias("claim"), F.when(x["l_discount"] == 0, F.expr("CAST(map() AS map<string,string>)")).otherwise(F.create_map(F.lit("k"), F.lit("v"))).alias("conditions"), F.lit("i").alias("inference"), F.when(x["l_returnflag"] == "R", F.lit(" ")).otherwise("q").alias("next_question"), F.filter(F.array(source(x)), lambda s: x["l_linenumber"] != 1).alias("sources")))
    edges = F.transform("l", lambda x, i: F.struct((i + 1).cast("int").alias("from_step_id"), (x["l_suppkey"] % 9).cast("int").alias("to_step_id"), none.alias("predicate"), none.alias("directionality")))
    docs = docs.select("l_orderkey", F.when(F.col("l_orderkey") % 7 == 0, " ").otherwise("d").alias("domain"), (2 - F.col("l_orderkey") % 2).alias("artifact_version"), steps.alias("steps"), edges.alias("edges"))
    return _kinds(docs, V.trajectory_errors(docs))


REVIEW = "subject predicate object time_interval start_date end_date valid_from valid_to verdict rationale hypothesis_relevance testability_signal corrected_start_date corrected_end_date corrected_valid_from corrected_valid_to corrected_time_source".split()


@query("graph_review_errors", """WITH e AS (SELECT event_id % 4 AS a, event_id % 5 AS b, event_id % 6 AS c, event_type FROM events)
SELECT error, count(*) AS n FROM (SELECT 'assertion #: missing temporal information' AS error FROM e WHERE a = 0 UNION ALL SELECT 'assertion #: missing end_date' FROM e WHERE a = 1 UNION ALL SELECT 'assertion #: invalid start_date' FROM e WHERE a = 2
UNION ALL SELECT 'assertion #: missing evidence' FROM e WHERE b = 0 UNION ALL SELECT 'assertion #: evidence.snippet_or_summary required' FROM e WHERE b = 1 UNION ALL SELECT 'assertion #: evidence should include page, figure_or_table, paper_id, or source' FROM e WHERE b = 2
UNION ALL SELECT 'assertion #: invalid verdict' FROM e WHERE c = 0 UNION ALL SELECT 'assertion #: needs_time_fix requires at least one corrected temporal field' FROM e WHERE c = 1 UNION ALL SELECT 'assertion #: hypothesis_relevance must be #/#/#' FROM e WHERE c = 3 UNION ALL SELECT 'assertion #: missing rationale' FROM e WHERE c = 4 UNION ALL SELECT 'assertion #: missing subject' FROM e WHERE event_type = 'error') GROUP BY error""")
def graph_review_errors(spark, sf_dir):
    """Events of a user as the assertions of a review."""
    n, text = F.col("event_id"), lambda c: c.cast("string")
    a, b, c = n % 4, n % 5, n % 6
    values = {
        "subject": F.when(F.col("event_type") != "error", "s"), "predicate": F.lit("p"), "object": F.lit("o"), "time_interval": F.when(a == 3, "2020"),
        "start_date": F.when(a == 1, "2020").when(a == 2, "May 2020"), "end_date": F.when(a == 2, "+inf"), "verdict": F.when(c == 0, "fine").when(c.isin(1, 2), "needs_time_fix").otherwise("accepted"),
        "rationale": F.when(c != 4, "r"), "hypothesis_relevance": F.when(c == 3, "7").otherwise("2"), "corrected_end_date": F.when(c == 2, "2021"),
    }
    evidence = F.struct(F.when(b == 1, "3").alias("page"), F.when(b == 3, "Figure 1").alias("figure_or_table"), text(F.lit(None)).alias("paper_id"), F.when(b == 4, "x").alias("source"), F.when(b > 1, "said").alias("snippet_or_summary"))
    row = F.struct(*(text(values.get(k, F.lit(None))).alias(k) for k in REVIEW), evidence.alias("evidence"))
    docs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(row).alias("assertions"))
    return _kinds(docs, V.graph_review_errors())


@query("other_review_errors", """WITH p AS (SELECT p_partkey % 4 AS a, p_size % 5 AS b FROM part) SELECT error, count(*) AS n FROM (
SELECT 'missing time_scope' AS error FROM p WHERE a = 0 UNION ALL SELECT 'missing scores object' FROM p WHERE b = 0 UNION ALL SELECT 'missing scores.testability' FROM p WHERE b <> 0 UNION ALL SELECT 'missing accept' FROM p WHERE a = 1 UNION ALL SELECT 'missing major_issues[]' FROM p WHERE a = 2 UNION ALL SELECT 'missing required_experiments' FROM p WHERE b = 1
UNION ALL SELECT 'item #: missing page' FROM p WHERE a = 0 UNION ALL SELECT 'item #: missing rationale' FROM p WHERE a = 1 UNION ALL SELECT 'item #: provide at least one of vlm_caption/tables_md/equations_md' FROM p WHERE b = 2 UNION ALL SELECT 'item #: invalid verdict' FROM p WHERE b = 3 UNION ALL SELECT 'item #: invalid verdict' FROM p WHERE b = 4 UNION ALL SELECT 'item #: missing verdict' FROM p WHERE b = 4
UNION ALL SELECT 'correction #: missing assertion_id' FROM p WHERE a = 0 UNION ALL SELECT 'correction #: missing corrected_time object' FROM p WHERE b = 0 UNION ALL SELECT 'correction #: corrected_time.granularity required' FROM p WHERE b = 1 UNION ALL SELECT 'correction #: corrected_time must include start and/or end' FROM p WHERE b = 2 UNION ALL SELECT 'correction #: invalid corrected_time.start' FROM p WHERE b = 3 UNION ALL SELECT 'correction #: invalid original_time.end' FROM p WHERE a = 3
UNION ALL SELECT 'corrections[] must be a non-empty list' FROM p WHERE a = 2) GROUP BY error""".replace("FROM p WHERE b = 0 UNION ALL SELECT 'correction #: corrected_time.g", "FROM p WHERE b = 0 AND a <> 2 UNION ALL SELECT 'correction #: corrected_time.g").replace("granularity required' FROM p WHERE b = 1 ", "granularity required' FROM p WHERE b = 1 AND a <> 2 ").replace("start and/or end' FROM p WHERE b = 2 ", "start and/or end' FROM p WHERE b = 2 AND a <> 2 ").replace("invalid corrected_time.start' FROM p WHERE b = 3 ", "invalid corrected_time.start' FROM p WHERE b = 3 AND a <> 2 "))
def other_review_errors(spark, sf_dir):
    """Reviews of hypotheses and of pages, and corrections, one of each per part."""
    a, b, none = F.col("p_partkey") % 4, F.col("p_size") % 5, F.lit(None).cast("string")
    time = lambda start, end, grain: F.struct(start.cast("string").alias("start"), end.cast("string").alias("end"), grain.cast("string").alias("granularity"))
    new = F.when(b == 0, time(none, none, none)).when(b == 1, time(F.lit("2020"), none, none)).when(b == 2, time(none, none, F.lit("year"))).when(b == 3, time(F.lit("soon"), none, F.lit("year"))).otherwise(time(F.lit("2020-01"), F.lit("unknown"), F.lit("month")))
    correction = F.struct(F.when(a != 0, "id").alias("assertion_id"), F.lit("r").alias("rationale"), new.alias("corrected_time"), time(none, F.when(a == 3, "then"), none).alias("original_time"))
    item = F.struct(F.when(a != 0, 1).alias("page"), F.when(b == 3, "fine").when(b != 4, "accepted").alias("verdict"), F.when(a != 1, "r").alias("rationale"), F.when(b != 2, "c").alias("vlm_caption"), none.alias("tables_md"), none.alias("equations_md"))
    docs = table(spark, sf_dir, "part").select(
        F.when(a != 0, "t").alias("time_scope"), F.when(b != 0, F.create_map(F.lit("novelty"), F.lit(1), F.lit("soundness"), F.lit(2))).alias("scores"), F.when(a != 1, True).alias("accept"), F.when(a != 2, F.array(F.lit("none"))).alias("major_issues"), F.when(b != 1, "e").alias("required_experiments"),
        F.array(item).alias("items"), F.when(a != 2, F.array(correction)).alias("corrections"),
    )
    return _kinds(docs, F.concat(V.hypothesis_review_errors(), V.mm_review_errors(), V.correction_errors()))


# -- resolution -------------------------------------------------------------------


@query("identity_keys", r"""WITH r AS (SELECT p_partkey, p_partkey % 6 AS f, lower(p_name) AS t FROM part)
SELECT p_partkey, CASE f WHEN 0 THEN 'doi:10.1234/p' || p_partkey WHEN 1 THEN 'arxiv:2001.' || printf('%05d', p_partkey) WHEN 2 THEN 'pmcid:pmc' || p_partkey WHEN 3 THEN 'pmid:' || (1000000 + p_partkey) WHEN 4 THEN 'https://x.org/p' || p_partkey || '.pdf,https://x.org/p' || p_partkey ELSE NULL END AS own, 'title:' || t AS title FROM r""")
def identity_keys(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    ref = F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("https://doi.org/10.1234/P"), k)).when(F.col("p_partkey") % 6 == 1, F.concat(F.lit("arXiv:2001."), F.format_string("%05d", "p_partkey"))).when(F.col("p_partkey") % 6 == 2, F.concat(F.lit("PMC"), k)).when(F.col("p_partkey") % 6 == 3, (F.col("p_partkey") + 1000000).cast("string")).when(F.col("p_partkey") % 6 == 4, F.concat(F.lit("HTTPS://X.org/p"), k, F.lit(".pdf?v=1#a")))
    keys = S.identity_keys(ref, F.concat("p_name", F.lit("!")))
    own = F.filter(keys, lambda x: ~x.startswith("title:") & ~(x.startswith("http") & F.lit(False)))
    # The address of a DOI is a key of its own; it is left out here.
    own = F.filter(own, lambda x: ~x.startswith("https://doi.org"))
    return table(spark, sf_dir, "part").select("p_partkey", F.nullif(F.array_join(own, ","), F.lit("")).alias("own"), F.element_at(keys, -1).alias("title"))


@query("resolved_entries", """WITH e AS (SELECT o_orderkey AS entry_id, o_custkey % 50 AS k FROM orders) SELECT min(entry_id) AS entry_id, '10.5555/c' || k AS id FROM e JOIN customer ON c_custkey = k GROUP BY k""")
def resolved_entries(spark, sf_dir):
    """Orders name customers as papers, by DOI in any spelling; every paper is resolved once, by its first entry."""
    papers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("10.5555/c"), F.col("c_custkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("title"))
    named = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "doi:").otherwise("https://doi.org/"), F.lit("10.5555/C"), (F.col("o_custkey") % 50).cast("string"))
    entries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), named.alias("ref"), F.lit("").alias("title"))
    return S.resolved(entries, papers)


@query("best_candidates", """WITH c AS (SELECT o_custkey AS entry_id, o_orderkey AS pos, round(CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 4.0 ELSE 0.0 END + greatest(0.0, 1.0 - 0.25 * abs(1996 - year(o_orderdate))) + CASE WHEN o_orderstatus = 'F' THEN 0.25 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 0.1 ELSE 0 END AS DOUBLE), 6) AS score FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, pos) AS r FROM c) SELECT entry_id, CAST(pos AS VARCHAR) AS id, score FROM b WHERE r = 1 AND score >= 1.75""")
def best_candidates(spark, sf_dir):
    """Orders as candidates for their customer's entry of 1996: the title is the same or missing."""
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry_id"), F.lit("x").alias("ref"), F.lit("A Title").alias("title"), F.lit(1996).alias("year"))
    none = F.lit(None).cast("string")
    o = table(spark, sf_dir, "orders")
    candidates = o.select(F.col("o_custkey").alias("entry_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderpriority") == "1-URGENT", "a title.").alias("title"), F.year("o_orderdate").alias("year"), none.alias("doi"), none.alias("arxiv"), none.alias("openalex"), F.when(F.col("o_orderstatus") == "F", "u").alias("pdf_url"), F.when(F.col("o_orderkey") % 2 == 0, "a").alias("abstract"))
    return S.best_candidates(entries, candidates).withColumn("score", F.round("score", 6))


@query("step_windows", """WITH y AS (SELECT l_orderkey AS step_id, CAST(1990 + p_size AS INT) AS y FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 4 <> 3) SELECT DISTINCT l.l_orderkey AS step_id, coalesce(CAST(a AS VARCHAR), 'unknown') AS start_date, coalesce(CAST(b AS VARCHAR), 'unknown') AS end_date FROM lineitem l LEFT JOIN (SELECT step_id, min(y) AS a, max(y) AS b FROM y GROUP BY 1) w ON l.l_orderkey = w.step_id""")
def step_windows(spark, sf_dir):
    """Lines as the sources of an order's step, parts as papers: named by id, DOI or title, or not known at all."""
    parts = table(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("string")
    name = F.concat(F.lit("paper "), k)
    papers = parts.select(F.col("p_partkey").alias("pos"), F.concat(F.lit("10.4321/p"), k).alias("id"), name.alias("title"), (F.col("p_size") + 1990).alias("year"))
    p = F.col("l_partkey").cast("string")
    ref = F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("10.4321/p"), p)).when(F.col("l_partkey") % 4 == 1, F.concat(F.lit("see https://doi.org/10.4321/P"), p)).when(F.col("l_partkey") % 4 == 2, F.concat(F.lit("Paper "), p, F.lit("!"))).otherwise("nowhere")
    sources = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_partkey", "l_linenumber").alias("source_id"), F.col("l_orderkey").alias("step_id"), ref.alias("ref")).distinct()
    return S.step_windows(sources.select("step_id"), sources, S.source_years(sources, papers))


@query("case_match", """WITH c AS (SELECT s_suppkey AS case_id, s_nationkey AS sig, CAST(floor(s_acctbal / 100) AS INT) AS hint FROM supplier), r AS (SELECT c_custkey AS row_id, c_nationkey AS sig, CAST(floor(c_acctbal / 100) AS INT) AS rank FROM customer),
s AS (SELECT case_id, row_id, CASE WHEN rank = hint THEN 106 WHEN abs(rank - hint) <= 2 THEN 103 ELSE 100 END AS score FROM c JOIN r ON c.sig = r.sig) SELECT case_id, row_id, score FROM s QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score DESC, row_id) = 1""")
def case_match(spark, sf_dir):
    """Suppliers as cases, customers of the nation as rows, hundreds of the balance as ranks."""
    rank = lambda c: F.floor(F.col(c) / 100).cast("int")
    cases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("case_id"), F.col("s_nationkey").alias("signature"), rank("s_acctbal").alias("hint"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("signature"), rank("c_acctbal").alias("rank"))
    return S.case_scores(cases, rows)


@query("asset_choice", """WITH s AS (SELECT o_orderkey AS case_id, l_linenumber AS asset_id, 10 * CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END + 5 * CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END + 3 * CASE WHEN l_linenumber = o_custkey % 7 THEN 1 ELSE 0 END AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT case_id, CAST(place AS INT) AS place, asset_id, score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, asset_id) AS place FROM s WHERE score > 0) WHERE place <= 2""")
def asset_choice(spark, sf_dir):
    """Lines as pictures whose names carry the order, a figure or a page."""
    name = F.concat(F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("Doc-X"), F.col("l_orderkey").cast("string"), F.lit("x-"))).otherwise("img-"), F.when(F.col("l_linenumber") == 2, "fig2-").otherwise(""), F.lit("page"), F.col("l_linenumber").cast("string"), F.lit("-end"))
    assets = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("asset_id"), F.col("l_orderkey").alias("ref"), name.alias("name"))
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderkey").alias("ref"), F.array(F.concat(F.lit("X"), F.col("o_orderkey").cast("string"), F.lit("X"))).alias("paper_ids"), F.lit("Of it").alias("title"), F.array(F.lit("fig 2")).alias("labels"), F.array((F.col("o_custkey") % 7).cast("int")).alias("pages"))
    return S.best_assets(S.asset_scores(assets, cases, "ref"), 2)


@query("image_choice", """WITH r AS (SELECT l_orderkey AS key, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS id, l_returnflag AS m, l_suppkey % 4 AS page, l_quantity FROM lineitem WHERE l_tax > 0), g AS (SELECT key, id, min(CASE WHEN l_quantity > 25 THEN 0 ELSE 1000000 END + CASE m WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 100000 + CASE WHEN page = 0 THEN 10000 ELSE page END) AS o FROM r GROUP BY 1, 2), p AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY o, id) AS place FROM g) SELECT key, CAST(place AS INT) AS place, id AS record_id FROM p WHERE place <= 3""")
def image_choice(spark, sf_dir):
    """Lines as records: those of over 25 pieces selected, the others in the pool, those without tax without an image."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber").cast("long") * 10000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("record_id"), (F.col("l_tax") > 0).alias("has_image"), F.when(F.col("l_returnflag") == "A", "figure").when(F.col("l_returnflag") == "N", "page").otherwise("text").alias("modality"), F.nullif((F.col("l_suppkey") % 4).cast("int"), F.lit(0)).alias("page"), "l_quantity")
    return S.image_records(rows.where("l_quantity > 25"), rows, 3)


# -- captured replies and sinks ---------------------------------------------------


def _raw(rows: DataFrame, **fields) -> DataFrame:
    return rows.select(F.to_json(F.struct(*(c.alias(k) for k, c in fields.items()))).alias("raw"))


def _replies(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    k, year = F.col("p_partkey").cast("string"), F.col("p_size") + 1990
    crossref = _raw(parts, DOI=F.concat(F.lit("10.1/P"), k), title=F.array("p_name"), author=F.array(F.struct(F.lit("Ann").alias("given"), F.col("p_brand").alias("family"))), issued=F.struct(F.array(F.array(year)).alias("date-parts")), **{"is-referenced-by-count": F.col("p_size")})
    words = F.create_map(F.col("p_name"), F.array(F.lit(1)), F.lit("the"), F.array(F.lit(0), F.lit(2)), F.lit("end"), F.array(F.lit(3)))
    openalex = _raw(parts.where("p_partkey % 2 = 0"), id=F.concat(F.lit("https://openalex.org/W1"), F.lpad(k, 6, "0")), doi=F.concat(F.lit("https://doi.org/10.1/p"), k), title=F.col("p_name"), publication_year=year, cited_by_count=F.col("p_size") * 2, abstract_inverted_index=words, open_access=F.struct(F.concat(F.lit("http://o/"), k).alias("oa_url")))
    return P.from_crossref(crossref), P.from_openalex(openalex)


@query("papers_from_replies", """SELECT 'doi:10.1/p' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'crossref,openalex' ELSE 'crossref' END AS sources, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'the ' || p_name || ' the end' END AS abstract, 1990 + p_size AS year, CASE WHEN p_partkey % 2 = 0 THEN 2 * p_size ELSE p_size END AS citation_count, CASE WHEN p_partkey % 2 = 0 THEN 'http://o/' || p_partkey END AS pdf_url, 'Ann ' || p_brand AS authors FROM part""")
def papers_from_replies(spark, sf_dir):
    """Parts as captured replies of two services, projected to papers and merged by canonical id."""
    out = P.federated(list(_replies(spark, sf_dir)))
    return out.select("id", "sources", "title", "abstract", "year", "citation_count", "pdf_url", F.array_join("authors", ";").alias("authors"))


@query("ranked_papers", """SELECT 'doi:10.1/p' || p_partkey AS id, round(CAST(3.0 * (CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END + CASE WHEN contains(p_name, 'small') THEN 1 ELSE 0 END) + 0.0008 * p_size + 0.0005 * (1990 + p_size) AS DOUBLE), 6) AS score FROM part ORDER BY score DESC, id LIMIT 20""")
def ranked_papers(spark, sf_dir):
    return P.ranked(_replies(spark, sf_dir)[0].withColumn("pdf_url", F.lit(None).cast("string")), "The small ring", 20).select("id", F.round("score", 6).alias("score"))


@query("pdf_candidates", """SELECT 'doi:10.1/p' || p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'http://o/' || p_partkey || ' ' ELSE '' END || 'https://doi.org/10.1/p' || p_partkey AS urls FROM part""")
def pdf_candidates(spark, sf_dir):
    rows = P.pdf_candidates(P.federated(list(_replies(spark, sf_dir))).drop("url").withColumn("url", F.lit(None).cast("string")))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]), " ").alias("urls"))


def _triplets(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select(F.concat(F.lit("p"), (F.col("event_id") % 50).cast("string")).alias("paper"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("predicate"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("object"), (F.col("value") / 100).alias("confidence"))


@query("strongest_edges", "SELECT 'u' || user_id AS subject, event_type AS predicate, 'k' || json_extract_string(props, '$.k') AS object, max(value) / 100 AS confidence FROM events GROUP BY 1, 2, 3")
def strongest_edges(spark, sf_dir):
    return K.strongest(_triplets(spark, sf_dir))


@query("entity_mentions", "SELECT DISTINCT 'p' || (event_id % 50) AS paper, e AS entity FROM (SELECT event_id, unnest(['u' || user_id, 'k' || json_extract_string(props, '$.k')]) AS e FROM events)")
def entity_mentions(spark, sf_dir):
    return K.mentions(_triplets(spark, sf_dir), "paper")


@query("property_graph", """WITH t AS (SELECT DISTINCT 'p' || (event_id % 50) AS paper, 'u' || user_id AS s, event_type AS p, 'k' || json_extract_string(props, '$.k') AS o FROM events) SELECT label, n FROM (SELECT 'Assertion' AS label, count(*) AS n FROM t UNION ALL SELECT 'Entity', (SELECT count(*) FROM (SELECT s FROM t UNION SELECT o FROM t)) UNION ALL SELECT 'Paper', (SELECT count(DISTINCT paper) FROM t) UNION ALL SELECT 'MENTIONS', (SELECT count(*) FROM (SELECT paper, s FROM t UNION SELECT paper, o FROM t)) UNION ALL SELECT 'SUBJECT', count(*) FROM t UNION ALL SELECT 'OBJECT', count(*) FROM t)""")
def property_graph(spark, sf_dir):
    """Rows per label and relationship."""
    tables = K.property_graph(_triplets(spark, sf_dir), "paper")
    return reduce(DataFrame.union, (t.agg(F.lit(name).alias("label"), F.count(F.lit(1)).alias("n")) for name, t in tables.items()))


@query("shown_edges", "WITH e AS (SELECT user_id, event_id % 60 AS p, event_id FROM events), a AS (SELECT user_id, list_sort(list(DISTINCT 'p' || printf('%02d', p))) AS papers, count(*) AS n FROM e GROUP BY 1) SELECT user_id, array_to_string(list_slice(papers, 1, 50), ',') AS papers, least(n, 10) AS n_quotes, least(n, 20) AS n_intervals FROM a")
def shown_edges(spark, sf_dir):
    """What a presentation shows of each user's events: fifty papers in order, ten quotes, twenty intervals."""
    paper = F.concat(F.lit("p"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(paper).alias("papers"), F.collect_list("event_type").alias("evidence_quotes"), F.collect_list(F.struct("ts")).alias("time_intervals"))
    return K.shown(rows).select("user_id", F.array_join("papers", ",").alias("papers"), F.size("evidence_quotes").alias("n_quotes"), F.size("time_intervals").alias("n_intervals"))


@query("safe_names", "SELECT page_id, CASE WHEN length(c) > 40 THEN substring(c, 1, 23) || '-' || substring(sha1(url), 1, 16) ELSE c END AS name FROM (SELECT page_id, url, regexp_replace(trim(url), '[^A-Za-z0-9._-]+', '_', 'g') AS c FROM pages)")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", K.safe_name(F.col("url"), 40).alias("name"))


@query("review_rows", """SELECT event_id, 'u' || user_id AS subject, event_type AS predicate, CASE WHEN event_id % 2 = 0 THEN 'yes' END AS verdict FROM events""")
def review_rows(spark, sf_dir):
    """Rows under other names come out under the canonical ones."""
    from lodestar.sources import bundles

    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("edge_id"), F.lit(" ").alias("subject"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("head"), F.col("event_type").alias("relation"), F.lit("o").alias("tail"), F.when(F.col("event_id") % 2 == 0, "yes").alias("label"))
    return bundles.aliased(rows).select(F.col("assertion_id").cast("long").alias("event_id"), "subject", "predicate", "verdict")


@query("tei_texts", "SELECT page_id, 'Title ' || page_id || ' Short. First part. Second part.' AS text FROM pages")
def tei_texts(spark, sf_dir):
    from lodestar.sources import bundles

    xml = F.concat(F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>Title '), F.col("page_id").cast("string"), F.lit("</title><abstract>Short.</abstract></teiHeader><text><p>First\n part.</p><p>Second part.</p></text></TEI>"))
    return table(spark, sf_dir, "pages").select("page_id", bundles.tei_text(xml).alias("text"))
