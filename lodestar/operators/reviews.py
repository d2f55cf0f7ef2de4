"""Assertion rows and their reviews: time spans, flattening, roles, overrides, verdicts without a model and demonstrations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions import text as T
from lodestar.operators.events import bitemporal, verdict_weight
from lodestar.operators.order import running

INTERVAL = "struct<start:string,end:string,granularity:string,source:string,paper_id:string,unit_id:string>"
#: Fields by which two intervals are the same, and what a missing one stands for.
INTERVAL_KEY = {"start": "", "end": "", "granularity": "year", "source": "extracted", "paper_id": "", "unit_id": ""}


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def date_key(date: Column) -> Column:
    """A key by which partial dates sort, what is missing counting as the latest."""
    parts = F.size(F.split(date, "-"))
    return F.when(F.coalesce(date, F.lit("")) == "", "9999-99-99").when(parts == 1, F.concat(date, F.lit("-99-99"))).when(parts == 2, F.concat(date, F.lit("-99"))).otherwise(date)


def interval_key(granularity: Column, start: Column, end: Column) -> Column:
    """granularity:start:end, the end being the start where it is missing."""
    return F.concat_ws(":", granularity, F.coalesce(start, F.lit("")), F.coalesce(end, start, F.lit("")))


def unique_intervals(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, time_intervals): the different intervals of each edge in the order of ``order``; equal in all six fields are the same.

    ``rows``: keys, order, and the fields of an interval.  Equal ones are
    grouped first, so a hot interval does not reach the list more than once.
    """
    same = [F.coalesce(f, F.lit(default)).alias(f"__{f}") for f, default in INTERVAL_KEY.items()]
    once = rows.groupBy(*keys, *same).agg(F.min_by(F.struct(F.col(order).alias("at"), *INTERVAL_KEY), order).alias("r"))
    return once.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.struct(*(r[f].alias(f) for f in INTERVAL_KEY))).alias("time_intervals"))


def flattened(edges: DataFrame) -> DataFrame:
    """(assertion_id, subject, predicate, object, start_date, end_date, valid_from, valid_to, time_source, time_interval): one row per edge.

    ``edges``: subject, predicate, object, score, time_intervals, years.  Spans
    come from the intervals that were extracted, else from all, else from the
    years counted; ids from the place by score, which only edges are ordered by.
    """
    taken = F.filter("time_intervals", lambda x: x["source"] == "extracted")
    any_extracted, any_interval = F.size(taken) > 0, F.size(F.coalesce("time_intervals", F.array())) > 0
    own = edges.withColumn("__used", F.when(any_extracted, taken).otherwise(F.col("time_intervals")))
    starts = F.filter(F.transform("__used", lambda x: _blank(x["start"])), lambda s: s.isNotNull())
    ends = F.filter(F.transform("__used", lambda x: F.coalesce(_blank(x["end"]), _blank(x["start"]))), lambda s: s.isNotNull())

    def by_key(dates: Column, pick) -> Column:
        return pick(F.transform(dates, lambda d: F.struct(date_key(d).alias("key"), d.alias("date"))))["date"]

    years = F.array_sort(F.coalesce("years", F.array().cast("array<int>")))
    start = F.when(any_interval, by_key(starts, F.array_min)).otherwise(F.get(years, F.lit(0)).cast("string"))
    end = F.when(any_interval, F.coalesce(by_key(ends, F.array_max), by_key(starts, F.array_min))).otherwise(F.get(years, F.size(years) - 1).cast("string"))
    source = F.when(any_extracted, "triplet_extractor").when(any_interval, "paper_year_fallback").otherwise("metadata")
    own = own.withColumns({"start_date": F.coalesce(start, F.lit("unknown")), "end_date": F.coalesce(end, F.lit("unknown")), "time_source": source})
    valid_to = F.when(F.col("end_date") != "unknown", F.col("end_date")).when(F.col("start_date") != "unknown", "+inf").otherwise("unknown")
    own = own.withColumns({"valid_from": F.col("start_date"), "valid_to": valid_to}).withColumn("__score", -F.col("score"))
    placed = running(own.drop("time_intervals", "__used", "years"), ["__score", "subject", "predicate", "object"])
    span = bitemporal(F.col("start_date"), F.col("end_date"), F.col("valid_from"), F.col("valid_to"))
    return placed.select(F.format_string("auto-%05d", "__place").alias("assertion_id"), "subject", "predicate", "object", "start_date", "end_date", "valid_from", "valid_to", "time_source", span.alias("time_interval"))


# Words by which an assertion's part in a hypothesis is told; the first that holds.
ROLES = {
    "contradiction": ("contrad", "inconsistent", "opposite", "negative result", "null"),
    "mechanism": ("increase", "decrease", "effect", "improve", "reduce", "cause", "lead", "induces"),
    "intervention": ("treatment", "intervention", "drug", "stimulation", "protocol"),
    "measurement": ("assay", "measure", "detect", "marker", "readout", "metric"),
    "boundary_condition": ("only when", "under", "condition", "environment", "temperature", "ph", "context"),
}
CAUSAL_STATUS = {
    "causal": ("cause", "lead", "drives", "induces", "mediates"),
    "correlational": ("associate", "correl", "linked", "related"),
    "theoretical": ("model", "hypothesis", "suggest", "propose"),
}


def _first_class(text: Column, classes: dict[str, tuple[str, ...]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, words in reversed(classes.items()):
        out = F.when(reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words)), name).otherwise(out)
    return out


def hypothesis_role(predicate: Column, subject: Column, object_: Column, evidence: Column) -> Column:
    return _first_class(F.lower(F.concat_ws(" ", predicate, subject, object_, evidence)), ROLES, "background")


def causal_status(predicate: Column, evidence: Column) -> Column:
    return _first_class(F.lower(F.concat_ws(" ", predicate, evidence)), CAUSAL_STATUS, "descriptive")


def time_type(source: Column) -> Column:
    return F.when(F.lower(source).isin("metadata", "publication_time"), "publication_time").otherwise("observation_period")


# What a review form begins with.
PREFILLED = {
    "verdict": "", "rationale": "", "hypothesis_role": "background", "hypothesis_relevance": "1", "testability_signal": "1",
    "causal_status": "descriptive", "severity": "warning", "leakage_risk": "possible", "time_type": "publication_time",
    "time_granularity": "unknown", "time_confidence": "medium", "mm_verdict": "",
}


def prefilled(rows: DataFrame, cutoff_year: Column) -> DataFrame:
    """Assertion rows with the columns of a review form at their first values."""
    return rows.withColumns({**{k: F.lit(v) for k, v in PREFILLED.items()}, "cutoff_year": F.coalesce(cutoff_year.cast("string"), F.lit(""))})


def review_assertions(docs: DataFrame) -> DataFrame:
    """(doc_id, subject, predicate, object, verdict): the assertions of a review, or of one without any its accepted, rejected and added edges."""
    row = lambda x, verdict: F.struct(x["subject"].alias("subject"), x["predicate"].alias("predicate"), x["object"].alias("object"), verdict.alias("verdict"))
    old = F.concat(*(_with_verdict(docs, kind, row) for kind in ("accepted", "rejected", "added")))
    new = F.transform("assertions", lambda x: row(x, x["verdict"]))
    return docs.select("doc_id", F.explode(F.when(F.size("assertions") > 0, new).otherwise(old)).alias("a")).select("doc_id", "a.*")


def _with_verdict(docs: DataFrame, kind: str, row) -> Column:
    edges = F.coalesce(f"{kind}_edges", F.array().cast(dict(docs.dtypes)[f"{kind}_edges"]))
    return F.transform(edges, lambda x: row(x, F.lit(kind)))


def compiled_overrides(assertions: DataFrame) -> DataFrame:
    """(subject, predicate, object, verdict, weight) of the reviews that weigh."""
    return assertions.select("subject", "predicate", "object", "verdict", verdict_weight(F.lower("verdict")).alias("weight"))


# Predicates that are noise without a look at the evidence.
ALWAYS_NOISE = ("associated_with", "is_associated_with", "are_associated_with", "related_to")


def fallback_verdict(predicate: Column, quality: Column, total_count: Column, confidence: Column, papers: Column) -> Column:
    """valid, noise or speculative without a model: by the predicate, else by the quality score, else by counts and confidence."""
    by_quality = F.when(quality >= 0.7, "valid").when(quality <= 0.25, "noise").otherwise("speculative")
    by_counts = F.when(((total_count >= 2) & (confidence >= 0.6)) | (papers >= 2), "valid").when((total_count == 1) & (confidence < 0.5), "noise").otherwise("speculative")
    return F.when(F.lower(F.trim(predicate)).isin(*ALWAYS_NOISE), "noise").when(quality >= 0, by_quality).otherwise(by_counts)


def confidence_gate(edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Edges with passed: whether the mean confidence, none counting as 0, reaches the threshold."""
    return edges.withColumn("passed", F.coalesce("mean_confidence", F.lit(0.0)) >= threshold)


def verified(edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Edges with verdict: rejected below the gate, else :func:`fallback_verdict`; valid and speculative ones stay in a graph."""
    gated = confidence_gate(edges, threshold)
    verdict = fallback_verdict(F.col("predicate"), F.col("quality"), F.col("total_count"), F.col("mean_confidence"), F.col("papers"))
    return gated.withColumn("verdict", F.when(F.col("passed"), verdict).otherwise("rejected")).withColumn("stays", F.col("verdict").isin("valid", "speculative")).drop("passed")


def batched(edges: DataFrame, paper: str, order: list[str], size: int = 80) -> DataFrame:
    """Edges with the number of their batch within a paper, for a model that takes ``size`` at a time."""
    return edges.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(paper).orderBy(*order)) - 1) / size))


def edge_counts(edges: DataFrame) -> DataFrame:
    """Edges with total_count (1 at least), papers_count, evidence_count, active_years_count, temporal_span_years and temporal_density.

    ``edges``: total_count, papers, evidence_quotes, yearly_count (a map by
    year) and time_intervals.  Years are those counted and those in which an
    interval starts or ends.
    """
    dates = F.flatten(F.transform("time_intervals", lambda x: F.array(x["start"], x["end"])))
    spans = F.filter(F.transform(dates, lambda d: F.nullif(F.regexp_extract(F.coalesce(F.trim(d), F.lit("")), "^([0-9]{4})", 1), F.lit("")).cast("int")), lambda y: y.isNotNull())
    out = edges.withColumn("__years", F.array_union(F.coalesce(F.map_keys("yearly_count"), F.array().cast("array<int>")), F.coalesce(spans, F.array().cast("array<int>"))))
    active, span = F.size("__years").cast("double"), (F.array_max("__years") - F.array_min("__years") + 1).cast("double")
    return out.withColumns({
        "total_count": F.greatest(F.lit(1.0), F.coalesce(F.col("total_count").cast("double"), F.lit(1.0))),
        "papers_count": F.size(F.filter(F.coalesce("papers", F.array().cast("array<string>")), lambda p: F.trim(p) != "")).cast("double"),
        "evidence_count": F.size(F.coalesce("evidence_quotes", F.array().cast("array<string>"))).cast("double"),
        "active_years_count": active,
        "temporal_span_years": F.coalesce(span, F.lit(0.0)),
        "temporal_density": F.when(F.size("__years") > 0, active / F.greatest(F.lit(1.0), span)).otherwise(0.0),
    }).drop("__years")


def compared(steps: DataFrame, links: DataFrame, automatic: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: steps and leads_to edges of the reference, edges and different terms of the automatic graph, papers resolved and those of them that the graph uses."""
    terms = automatic.select(F.explode(F.array("subject", "object")).alias("t")).agg(F.countDistinct("t").alias("automatic_unique_terms"))
    used = automatic.select(F.explode("papers").alias("id")).distinct().join(resolved.select("id").distinct(), "id", "left_semi").agg(F.count(F.lit(1)).alias("papers_reaching_automatic_graph"))
    parts = [steps.agg(F.count(F.lit(1)).alias("reference_steps")), links.agg(F.count_if(F.col("predicate") == "leads_to").alias("reference_edges")), automatic.agg(F.count(F.lit(1)).alias("automatic_edges")), terms, resolved.agg(F.count(F.lit(1)).alias("resolved_papers")), used]
    return reduce(DataFrame.crossJoin, parts)


def event_stream(events: DataFrame, times: DataFrame, limit: int = 1000) -> DataFrame:
    """The first ``limit`` events by start and id; what an event does not say of its time comes from the time it is linked to."""
    t = times.select(F.col("time_id").alias("__t"), *(F.col(c).alias(f"__{c}") for c in ("start", "end", "granularity")))
    joined = events.join(t, F.col("time_id") == F.col("__t"), "left")
    out = joined.withColumns({"ts_start": F.coalesce("ts_start", "__start"), "ts_end": F.coalesce("ts_end", "__end"), "granularity": F.coalesce("granularity", "__granularity")})
    return out.drop("__t", "__start", "__end", "__granularity").orderBy(F.asc_nulls_first("ts_start"), "event_id").limit(limit)


def review_demos(assertions: DataFrame) -> DataFrame:
    """(id, domain, quality, chunk_text, triplet): demonstrations from reviewed assertions, gold if accepted, else silver.

    ``assertions``: domain, paper_id, assertion_id, path, page,
    figure_or_table, snippet, subject, predicate, object, verdict.
    """
    place = F.concat_ws(", ", F.concat(F.lit("page="), F.col("page").cast("string")), _blank(F.col("figure_or_table")))
    text = F.trim(F.concat(F.lit("["), F.coalesce("paper_id", F.lit("")), F.lit("] "), place, F.lit("\n"), F.coalesce("snippet", F.lit(""))))
    name = F.substring(F.sha1(F.concat_ws("|", F.lit("temporal_triplets"), *(F.coalesce(c, F.lit("")) for c in ("domain", "paper_id", "assertion_id", "path")))), 1, 16)
    return assertions.select(name.alias("id"), "domain", F.when(F.lower("verdict") == "accepted", "gold").otherwise("silver").alias("quality"), text.alias("chunk_text"), F.to_json(F.struct("subject", "predicate", "object")).alias("triplet"))


def hypothesis_demos(reviews: DataFrame) -> DataFrame:
    """(id, quality, hypothesis_text, verdict, summary, confidence): demonstrations from reviews of hypotheses.

    ``reviews``: domain, hypothesis_id, path, time_scope, major_issues,
    minor_issues (arrays), suggested_revision, accept.
    """
    major, minor = F.array_join("major_issues", "; "), F.array_join("minor_issues", "; ")
    parts = [F.concat(F.lit(head), _blank(body)) for head, body in (("Time scope: ", F.col("time_scope")), ("Major: ", major), ("Minor: ", minor), ("Suggested revision: ", F.col("suggested_revision")))]
    accept = F.coalesce("accept", F.lit(False))
    name = F.substring(F.sha1(F.concat_ws("|", F.lit("hypothesis_test"), *(F.coalesce(c, F.lit("")) for c in ("domain", "hypothesis_id", "path")))), 1, 16)
    summary = F.coalesce(_blank(F.col("suggested_revision")), _blank(major), F.lit("Needs revision"))
    return reviews.select(name.alias("id"), F.when(accept, "gold").otherwise("silver").alias("quality"), F.trim(F.concat_ws("\n", *parts)).alias("hypothesis_text"), F.when(accept, "supported").otherwise("needs_revision").alias("verdict"), summary.alias("summary"), F.when(accept, 6).otherwise(5).alias("confidence"))


def review_variants(rows: DataFrame, system: str, label: str, most: int = 5) -> DataFrame:
    """(rank, signature, variant): ranked hypotheses as one side of a review sees them.

    ``rows``: rank, source, predicate, target, title, premise, mechanism,
    time_scope, final_score, evidence (an array of source_id and snippet, of
    which the first ``most`` different ones stay), first_seen, last_seen,
    ordering.
    """
    signature = F.concat_ws("|", *(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " ")) for c in ("source", "predicate", "target")))
    cited = F.slice(F.array_distinct(F.filter(F.coalesce("evidence", F.array().cast(dict(rows.dtypes)["evidence"])), lambda e: _blank(e["snippet"]).isNotNull())), 1, most)
    seen = F.when(F.col("first_seen").isNotNull(), F.concat_ws(" ", F.col("ordering"), F.concat(F.col("first_seen").cast("string"), F.lit("-"), F.col("last_seen").cast("string")))).otherwise(F.coalesce("ordering", F.lit("")))
    text = lambda c: F.coalesce(F.trim(c), F.lit("")).alias(c)
    variant = F.struct(F.lit(system).alias("system_id"), F.lit(label).alias("display_label"), *map(text, ("title", "premise", "mechanism", "time_scope")), F.round("final_score", 4).alias("score"), cited.alias("supporting_evidence"), seen.alias("temporal_summary"))
    return rows.select("rank", signature.alias("signature"), variant.alias("variant"))


def payloads(rows: DataFrame, key: str) -> DataFrame:
    """(key, payload): rows as JSON without what is null in them, and :func:`records` the other way."""
    return rows.select(key, F.to_json(F.struct(*(c for c in rows.columns if c != key))).alias("payload"))


def records(rows: DataFrame, key: str, schema: str) -> DataFrame:
    """Payloads of :func:`payloads` as rows again."""
    return rows.select(key, F.from_json("payload", schema).alias("r")).select(key, "r.*")


def keywords(text: Column, k: int = 10) -> Column:
    """The first ``k`` different tokens of a text."""
    return F.slice(F.array_distinct(T.tokens(text)), 1, k)
