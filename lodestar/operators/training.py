"""Records for supervised, preference and reinforcement training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions import text as T
from lodestar.operators.datasets import hardness
from lodestar.operators.rewards import canonical_verdict, opposite

# Answers that a bootstrapped pair rejects, and reasons that it gives.
NO_REASON = "Use the provided paper evidence and expert annotation."
WRONG = "Incorrect preference bootstrap negative: contradicts the expert target."


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _object(**fields: Column) -> Column:
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))


def target_pairs(rows: DataFrame, synthetic: bool = True) -> DataFrame:
    """(id, task_family, chosen, rejected, synthetic, hardness): preference pairs from the targets of reinforcement rows.

    ``rows``: id, task_family, expected_verdict, rationale, reference_temporal,
    reference_assertions, reference_label, rejected.  The chosen answer states
    the target of its family; the rejected one is the row's own or contradicts
    it.  Rows without a target, and without ``synthetic`` those without a
    rejected answer of their own, give none; nor do equal answers.
    """
    family, verdict = F.col("task_family"), canonical_verdict(F.col("expected_verdict"))
    reason = F.coalesce(_blank(F.col("rationale")), F.lit(NO_REASON))
    has = {k: _blank(F.col(k)).isNotNull() for k in ("expected_verdict", "reference_temporal", "reference_assertions", "reference_label")}
    chosen = (
        F.when((family == "assertion_review_rl") & has["expected_verdict"], _object(verdict=verdict, rationale=reason))
        .when((family == "mm_review_rl") & has["expected_verdict"], _object(mm_verdict=verdict, rationale=reason))
        .when((family == "temporal_fix_rl") & has["reference_temporal"], F.col("reference_temporal"))
        .when((family == "trajectory_reasoning_rl") & has["reference_assertions"], _object(inference=F.lit("supported"), next_question=F.lit("verify remaining evidence"), extracted_assertions=F.col("reference_assertions")))
        .when((family == "image_label_rl") & has["reference_label"], _object(label=F.col("reference_label")))
    )
    wrong = (
        F.when(family == "assertion_review_rl", _object(verdict=opposite(verdict), rationale=F.lit(WRONG)))
        .when(family == "mm_review_rl", _object(mm_verdict=opposite(verdict), rationale=F.lit(WRONG)))
        .when(family == "temporal_fix_rl", _object(start_date=F.lit("unknown"), end_date=F.lit("unknown"), time_source=F.lit("missing")))
        .when(family == "trajectory_reasoning_rl", _object(inference=F.lit("unsupported"), next_question=F.lit("unknown"), extracted_assertions=F.array().cast("array<string>")))
        .when(family == "image_label_rl", _object(label=F.lit("unknown")))
    )
    own = _blank(F.col("rejected"))
    out = rows.select(F.concat(F.lit("dpo-grpo:"), F.col("id").cast("string")).alias("id"), F.regexp_replace("task_family", "_rl", "").alias("task_family"), chosen.alias("chosen"), (own if not synthetic else F.coalesce(own, wrong)).alias("rejected"), own.isNull().alias("synthetic"))
    out = out.where(F.col("chosen").isNotNull() & F.col("rejected").isNotNull() & (T.norm("chosen") != T.norm("rejected")))
    return out.withColumn("hardness", hardness(F.col("chosen"), F.col("rejected")))


def with_images(rows: DataFrame, most: int) -> DataFrame:
    """Rows with images, the first ``most`` different ones (0: all), and image, the first of them; both were arrays or one name."""
    kept = F.array_distinct(F.filter(F.when(F.size(F.coalesce("images", F.array().cast("array<string>"))) > 0, F.col("images")).otherwise(F.array("image")), lambda x: _blank(x).isNotNull()))
    kept = F.slice(kept, 1, most) if most > 0 else kept
    return rows.withColumn("n_before", F.size(F.coalesce("images", F.array().cast("array<string>")))).withColumn("images", kept).withColumn("image", F.get("images", F.lit(0)))


def label_records(rows: DataFrame) -> DataFrame:
    """(id, task, messages): a supervised and a reinforcement record of every labelled image; the latter leaves the answer out."""
    user = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    answer = F.struct(F.lit("assistant").alias("role"), _object(label=F.col("label"), label_id=F.col("label_id")).alias("content"))
    tasks = F.array(F.struct(F.lit("sft").alias("task"), F.array(user, answer).alias("messages")), F.struct(F.lit("grpo").alias("task"), F.array(user).alias("messages")))
    return rows.where(_blank(F.col("label")).isNotNull()).select("id", F.explode(tasks).alias("r")).select("id", "r.*")


def manifest_relations(cases: DataFrame) -> dict[str, DataFrame]:
    """records, flat and rationales of the cases of manifests, and one row of stats.

    ``cases``: manifest, case_id, paper_id, images (array), reference (a JSON
    answer), rationales (array).  Cases without a reference are counted and left
    out; flat has a row per image, rationales one per reason.
    """
    own = cases.withColumn("ready", _blank(F.col("reference")).isNotNull())
    good = own.where("ready")
    records = good.select(F.concat_ws(":", "manifest", "case_id").alias("record_id"), "paper_id", "images", "reference")
    flat = good.select(F.concat_ws(":", "manifest", "case_id").alias("record_id"), F.posexplode("images").alias("pos", "image"))
    reasons = good.select(F.concat_ws(":", "manifest", "case_id").alias("record_id"), F.posexplode(F.filter("rationales", lambda r: _blank(r).isNotNull())).alias("pos", "rationale"))
    stats = own.agg(F.count(F.lit(1)).alias("cases"), F.count_if("ready").alias("records"), F.count_if(F.col("ready") & (F.size("images") == 0)).alias("without_images"), F.countDistinct("manifest").alias("manifests"))
    return {"records": records, "flat": flat, "rationales": reasons, "stats": stats}


def aligned_messages(messages: Column, n_images: Column) -> Column:
    """Messages, arrays of (type, text) blocks by role, with exactly ``n_images`` image blocks: those too many go, missing ones come first in the first turn of the user.

    A message of which nothing is left goes.
    """
    is_image = lambda b: b["type"] == "image"
    block = "struct<type:string,text:string>"
    image = F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))

    def cut(state: Column, m: Column) -> Column:
        room = n_images - state["seen"]
        own = F.size(F.filter(m["content"], is_image))
        kept = F.filter(m["content"], lambda b, i: ~is_image(b) | (F.size(F.filter(F.slice(m["content"], F.lit(1), i + 1), is_image)) <= room))
        out = F.when(F.size(kept) > 0, F.concat(state["out"], F.array(F.struct(m["role"].alias("role"), kept.alias("content"))))).otherwise(state["out"])
        return F.struct((state["seen"] + F.least(own, room)).alias("seen"), out.alias("out"))

    start = F.struct(F.lit(0).alias("seen"), F.expr(f"CAST(array() AS array<struct<role:string,content:array<{block}>>>)").alias("out"))

    def filled(state: Column) -> Column:
        missing = F.array_repeat(image, n_images - state["seen"])
        users = F.transform(state["out"], lambda m: m["role"] == "user")
        first = F.array_position(users, True)
        some = F.transform(state["out"], lambda m, i: F.struct(m["role"].alias("role"), F.when(i + 1 == first, F.concat(missing, m["content"])).otherwise(m["content"]).alias("content")))
        alone = F.concat(F.array(F.struct(F.lit("user").alias("role"), missing.alias("content"))), state["out"])
        return F.when(F.size(missing) == 0, state["out"]).when(first > 0, some).otherwise(alone)

    return F.aggregate(messages, start, cut, filled)


def ready_rows(rows: DataFrame, family: str, wanted: dict[str, list[str]]) -> DataFrame:
    """Rows that have, themselves or in the map ``metadata``, any target of their family; families without a list need none."""
    keep = F.lit(True)
    for name, fields in wanted.items():
        found = [_blank(F.col(f).cast("string")).isNotNull() for f in fields if f in rows.columns] + [_blank(F.try_element_at("metadata", F.lit(f))).isNotNull() for f in fields]
        any_found = F.lit(False)
        for test in found:
            any_found = any_found | F.coalesce(test, F.lit(False))
        keep = F.when(F.col(family) == name, any_found).otherwise(keep)
    return rows.where(keep)


def normalised_rows(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Rows with at most ``most`` images, and one row of counters over all of them."""
    out = with_images(rows, most)
    ids = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("duplicate_ids"))
    counters = out.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("images") > 0).alias("with_images"), F.sum("n_before").alias("refs_before"), F.sum(F.size("images")).alias("refs_after"), F.count_if(F.col("n_before") > F.size("images")).alias("truncated"), F.countDistinct("task_family").alias("families"))
    return out.drop("n_before"), counters.crossJoin(ids)


def image_cap(locators: Column, has_table: Column, has_figure: Column, most: int) -> Column:
    """1 + 0.6 of the locators, rounded up, + 1 each for a table and a figure; at least 1, at most ``most``."""
    return F.greatest(F.lit(1), F.least(F.lit(most), 1 + F.ceil(0.6 * locators).cast("int") + has_table.cast("int") + has_figure.cast("int")))


def needs_model(modality: Column, text: Column, image: Column, cached: Column) -> Column:
    """Whether a chunk needs a look by a vision model: it has an image, no stored reply, and is no table or formula with text."""
    kind, written = F.lower(F.trim(F.coalesce(modality, F.lit("unknown")))), _blank(text).isNotNull()
    wanted = kind.isin("page", "figure", "table", "formula", "unknown") | ~written
    return _blank(image).isNotNull() & ~F.coalesce(cached, F.lit(False)) & ~(kind.isin("table", "formula") & written) & wanted


def contains_term(a: Column, b: Column) -> Column:
    """Whether one of two terms, neither blank, contains the other."""
    x, y = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (a, b))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def charge_steps(profiles: DataFrame) -> DataFrame:
    """(profile, pos, seconds, step): the stages of charging profiles, each as long as its share of the charge takes at its rate."""
    rows = profiles.select("profile", F.posexplode("stages").alias("pos", "s")).select("profile", "pos", "s.*")
    seconds = (F.col("soc_to") - F.col("soc_from")) / F.col("c_rate") * 3600
    return rows.where("c_rate > 0").select("profile", "pos", seconds.alias("seconds"), F.format_string("Charge at %sC for %.0f seconds", F.col("c_rate").cast("string"), seconds).alias("step"))


def cost_estimates(scenarios: DataFrame) -> DataFrame:
    """Scenarios (hours, price, budget, reserve) with what they cost, with the reserve, what is left and whether it fits."""
    cost = F.round(F.col("hours") * F.col("price"), 2)
    total = F.round(F.col("hours") * F.col("price") + F.col("reserve"), 2)
    return scenarios.withColumns({"compute_cost": cost, "total": total, "remaining": F.round(F.col("budget") - total, 2), "safe_hours": F.round(F.greatest(F.lit(0.0), F.col("budget") - F.col("reserve")) / F.col("price"), 2), "fits": total <= F.col("budget")})


# -- records from corrections -------------------------------------------------------

FIXED = ("subject", "predicate", "object", "start_date", "end_date")
SYSTEM = {
    "graph_repair": "Mend assertions of a scientific graph by an expert's review. Answer with JSON alone.",
    "temporal_fix": "Mend the time of scientific assertions. Answer with JSON alone.",
    "mm_caption_fix": "Revise what is said of scientific figures by an expert's review.",
}


def _corrected(assertions: DataFrame) -> tuple[dict[str, Column], dict[str, Column]]:
    """The fields of reviewed assertions as they were and as corrected."""
    old = {k: F.coalesce(_blank(F.col(k)), F.lit("unknown") if k.endswith("_date") else F.lit(None)) for k in FIXED}
    new = {k: F.coalesce(_blank(F.col(f"corrected_{k}")), _blank(F.col("corrected_time_interval")) if k == "start_date" else F.lit(None), old[k]) for k in FIXED}
    return old, new


def _chat(task: str, user: Column, answer: Column) -> Column:
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(said("system", F.lit(SYSTEM[task])), said("user", user), said("assistant", answer))


def _numbered(rows: DataFrame, name: str) -> Column:
    return F.concat_ws(":", F.lit(name), F.col("source_id").cast("string"), F.col("pos").cast("string"))


def repair_records(assertions: DataFrame) -> DataFrame:
    """(id, task_family, messages): a supervised record of every reviewed assertion with a field that is known after the review.

    ``assertions``: source_id, pos, the five fields, their corrected_ forms,
    corrected_time_interval, verdict, rationale, evidence (JSON).
    """
    old, new = _corrected(assertions)
    given = F.lit(False)
    for k in FIXED:
        value = F.coalesce(_blank(F.col(f"corrected_{k}")), _blank(F.col("corrected_time_interval")) if k == "start_date" else F.lit(None), _blank(F.col(k)) if k.endswith("_date") else F.lit(None))
        given = given | F.coalesce(value != "unknown", F.lit(False))
    user = F.concat(F.lit("Assertion: "), _object(**old), F.lit("\nEvidence: "), F.coalesce("evidence", F.lit("{}")), F.lit("\nVerdict: "), F.coalesce("verdict", F.lit("")), F.lit("\nRationale: "), F.coalesce("rationale", F.lit("")))
    return assertions.where(given).select(_numbered(assertions, "graph_repair").alias("id"), F.lit("graph_repair").alias("task_family"), _chat("graph_repair", user, _object(**new)).alias("messages"))


def repair_pairs(assertions: DataFrame) -> DataFrame:
    """(id, task_family, chosen, rejected): a preference pair of every reviewed assertion with a corrected field, corrected against given."""
    old, new = _corrected(assertions)
    fixed = F.coalesce(*(_blank(F.col(f"corrected_{k}")) for k in FIXED), _blank(F.col("corrected_time_interval"))).isNotNull()
    return assertions.where(fixed).select(_numbered(assertions, "graph_pref").alias("id"), F.lit("graph_repair_preference").alias("task_family"), _object(**new).alias("chosen"), _object(**old).alias("rejected"))


def time_records(corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Supervised records (id, task_family, messages) and preference pairs (id, task_family, chosen, rejected) of corrected times.

    ``corrections``: source_id, pos, assertion_id, rationale, original and
    corrected, JSON objects.  A pair needs both, a record the corrected one.
    """
    new, old = _blank(F.col("corrected")), _blank(F.col("original"))
    user = F.concat(F.lit("Assertion: "), F.coalesce("assertion_id", F.lit("")), F.lit("\nTime: "), F.coalesce(old, F.lit('{"granularity":"unknown"}')), F.lit("\nRationale: "), F.coalesce("rationale", F.lit("")))
    own = corrections.where(new.isNotNull())
    records = own.select(_numbered(own, "temporal_fix").alias("id"), F.lit("temporal_fix").alias("task_family"), _chat("temporal_fix", user, new).alias("messages"))
    pairs = own.where(old.isNotNull()).select(_numbered(own, "temporal_pref").alias("id"), F.lit("temporal_preference").alias("task_family"), new.alias("chosen"), old.alias("rejected"))
    return records, pairs


def caption_records(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Supervised records and preference pairs of revised captions, as :func:`time_records`.

    ``items``: source_id, pos, page, verdict, rationale, original, corrected.  A
    caption that did not change gives no pair.
    """
    new, old = _blank(F.col("corrected")), _blank(F.col("original"))
    user = F.concat(F.lit("Page: "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit("\nCaption: "), F.coalesce(old, F.lit("unknown")), F.lit("\nVerdict: "), F.coalesce("verdict", F.lit("")), F.lit("\nRationale: "), F.coalesce("rationale", F.lit("")))
    own = items.where(new.isNotNull())
    records = own.select(_numbered(own, "mm_review").alias("id"), F.lit("mm_caption_fix").alias("task_family"), _chat("mm_caption_fix", user, new).alias("messages"))
    pairs = own.where(old.isNotNull() & (old != new)).select(_numbered(own, "mm_pref").alias("id"), F.lit("mm_caption_preference").alias("task_family"), new.alias("chosen"), old.alias("rejected"))
    return records, pairs


def step_samples(steps: DataFrame) -> DataFrame:
    """(doc, pos, messages): a record of every step of a trajectory, with the steps before it as context and its inference as the answer.

    ``steps``: doc, pos, claim, inference.  Steps without an inference are
    context only.
    """
    before = W.partitionBy("doc").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    context = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "claim")).over(before)), lambda x: F.concat(F.lit("- "), F.coalesce(x["claim"], F.lit("")))), "\n")
    user = F.concat(F.lit("Earlier steps:\n"), context, F.lit("\nClaim: "), F.coalesce("claim", F.lit("")))
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    rows = steps.select("doc", "pos", F.array(said("user", user), said("assistant", F.col("inference"))).alias("messages"), _blank(F.col("inference")).isNotNull().alias("__ok"))
    return rows.where("__ok").drop("__ok")


def verdict_samples(assertions: DataFrame, verdicts: tuple[str, ...] = ("accepted", "rejected", "needs_time_fix", "needs_evidence_fix")) -> DataFrame:
    """(doc, pos, prompt, expected_verdict): reinforcement rows of the assertions whose expert verdict is one of these."""
    own = assertions.where(F.lower(F.trim("verdict")).isin(*verdicts))
    return own.select("doc", "pos", F.to_json(F.struct("subject", "predicate", "object")).alias("prompt"), F.lower(F.trim("verdict")).alias("expected_verdict"))


def mixed_images(messages: Column) -> Column:
    """The images of chat messages (role, content blocks of type, text, image), in order, as one array."""
    return F.filter(F.flatten(F.transform(messages, lambda m: F.transform(m["content"], lambda b: F.when(b["type"] == "image", b["image"])))), lambda x: x.isNotNull())


def collected_refs(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, pos, ref): the references in several columns and arrays of a row, each once, in the order of the columns."""
    kinds = dict(rows.dtypes)
    parts = [F.col(c) if kinds[c].startswith("array") else F.array(F.col(c).cast("string")) for c in columns]
    refs = F.array_distinct(F.filter(F.transform(F.flatten(F.array(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))), lambda r: F.trim(r)), lambda r: r != ""))
    return rows.select(key, F.posexplode(refs).alias("pos", "ref"))
