"""What is wrong with trajectories and reviews: an array of messages per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dates that a review may give, and verdicts that it may reach.
TIME_TOKEN = r"^(\d{4}|\d{4}-\d{2}|\d{4}-\d{2}-\d{2}|unknown|\+inf|-inf)$"
VERDICTS = ("accepted", "rejected", "needs_time_fix", "needs_evidence_fix", "added", "uncertain")
MM_VERDICTS = ("accepted", "needs_fix", "rejected")
DIRECTIONS = ("directed", "bidirectional", "simultaneous")
SOURCE_TYPES = ("text", "image", "table")


def empty(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) == ""


def no_time(c: Column) -> Column:
    return ~F.coalesce(F.trim(c), F.lit("")).rlike(TIME_TOKEN)


def messages(*tests: tuple[Column, Column | str]) -> Column:
    """The messages whose tests hold, in order."""
    return F.array_compact(F.array(*(F.when(test, message if isinstance(message, Column) else F.lit(message)) for test, message in tests)))


def _each(items: str | Column, name: str, body) -> Column:
    """Messages of every item of an array, each with its number before it."""
    return F.flatten(F.transform(items, lambda x, i: F.transform(body(x), lambda m: F.concat(F.lit(f"{name} "), (i + 1).cast("string"), F.lit(": "), m))))




def trajectory_errors(docs: DataFrame) -> Column:
    """Of documents with domain, artifact_version, steps and edges.

    steps: claim, conditions (a map), inference, next_question, sources (type,
    source, snippet_or_summary); edges: from_step_id, to_step_id, predicate,
    directionality.  Sources are asked for from version 2 on.
    """
    n = F.size("steps")

    def source(x: Column) -> Column:
        kind = F.lower(F.trim(F.coalesce(x["type"], F.lit(""))))
        kind = F.when(kind == "figure", "image").otherwise(kind)
        return messages((~kind.isin(*SOURCE_TYPES), "invalid type"), (empty(x["source"]), "source required"), (empty(x["snippet_or_summary"]), "snippet_or_summary required"))

    def step(x: Column) -> Column:
        sources = F.coalesce(x["sources"], F.array().cast("array<struct<type:string,source:string,snippet_or_summary:string>>"))
        own = messages(
            (empty(x["claim"]), "missing claim"),
            (F.coalesce(F.size(x["conditions"]), F.lit(0)) <= 0, "missing conditions"),
            (empty(x["inference"]), "missing inference"),
            (empty(x["next_question"]), "missing next_question"),
            ((F.col("artifact_version") >= 2) & (F.size(sources) == 0), "missing sources[]"),
        )
        return F.concat(own, F.when(F.col("artifact_version") >= 2, _each(sources, "source", source)).otherwise(F.array().cast("array<string>")))

    def key(e: Column) -> Column:
        predicate = F.when(empty(e["predicate"]), "leads_to").otherwise(F.trim(e["predicate"]))
        return F.concat_ws("|", e["from_step_id"].cast("string"), e["to_step_id"].cast("string"), predicate, _direction(e))

    def usable(e: Column) -> Column:
        return (e["from_step_id"] != e["to_step_id"]) & e["from_step_id"].between(1, n) & e["to_step_id"].between(1, n)

    edges = F.coalesce("edges", F.array().cast(dict(docs.dtypes)["edges"]))

    def edge(e: Column, i: Column) -> Column:
        # A duplicate is one whose key an earlier usable edge has.
        before = F.filter(F.slice(edges, F.lit(1), i), lambda o: usable(o) & (key(o) == key(e)))
        unknown = e["from_step_id"].isNull() | e["to_step_id"].isNull()
        return messages(
            (unknown, "from_step_id/to_step_id must be integers"),
            (~unknown & ~_direction(e).isin(*DIRECTIONS), "invalid directionality"),
            (e["from_step_id"] == e["to_step_id"], "self-loop is not allowed"),
            ((e["from_step_id"] != e["to_step_id"]) & ~usable(e), "out of range"),
            (usable(e) & (F.size(before) > 0), "duplicate edge"),
        )

    edge_errors = F.flatten(F.transform(edges, lambda e, i: F.transform(edge(e, i), lambda m: F.concat(F.lit("edge "), (i + 1).cast("string"), F.lit(": "), m))))
    top = messages((empty(F.col("domain")), "domain required"))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.concat(top, F.array(F.lit("steps[] must be a non-empty list")))).otherwise(F.concat(top, _each("steps", "step", step), edge_errors))


def _direction(e: Column) -> Column:
    return F.when(empty(e["directionality"]), "directed").otherwise(F.lower(F.trim(e["directionality"])))


SPAN = ("start_date", "end_date", "valid_from", "valid_to")


def graph_review_errors(assertions: str = "assertions") -> Column:
    """Of reviews whose assertions have subject, predicate, object, time_interval, the dates, evidence (a struct), verdict, rationale, the corrected dates and the two scores."""

    def one(a: Column) -> Column:
        structured = reduce(lambda x, y: x | y, (~empty(a[k]) for k in SPAN))
        ev = a["evidence"]
        bare = ev.isNull() | reduce(lambda x, y: x & y, (empty(ev[k]) for k in ("page", "figure_or_table", "paper_id", "source", "snippet_or_summary")))
        placed = reduce(lambda x, y: x | y, (~empty(ev[k]) for k in ("page", "figure_or_table", "paper_id", "source")))
        fixes = reduce(lambda x, y: x & y, (empty(a[f"corrected_{k}"]) for k in (*SPAN, "time_source")))
        score = lambda k: ~empty(a[k]) & ~a[k].isin("0", "1", "2")
        verdict = F.coalesce(F.trim(a["verdict"]), F.lit(""))
        return messages(
            *((empty(a[k]), f"missing {k}") for k in ("subject", "predicate", "object")),
            (empty(a["time_interval"]) & ~structured, "missing temporal information"),
            *((structured & empty(a[k]), f"missing {k}") for k in SPAN[:2]),
            *((structured & ~empty(a[k]) & no_time(a[k]), f"invalid {k}") for k in SPAN),
            (bare, "missing evidence"),
            (~bare & empty(ev["snippet_or_summary"]), "evidence.snippet_or_summary required"),
            (~bare & ~placed, "evidence should include page, figure_or_table, paper_id, or source"),
            (~verdict.isin(*VERDICTS), "invalid verdict"),
            ((verdict == "needs_time_fix") & fixes, "needs_time_fix requires at least one corrected temporal field"),
            (score("hypothesis_relevance"), "hypothesis_relevance must be 0/1/2"),
            (score("testability_signal"), "testability_signal must be 0/1/2"),
            (empty(a["rationale"]), "missing rationale"),
        )

    return F.when(F.coalesce(F.size(assertions), F.lit(0)) <= 0, F.array(F.lit("assertions[] must be a non-empty list"))).otherwise(_each(assertions, "assertion", one))


def hypothesis_review_errors() -> Column:
    """Of reviews with time_scope, scores (a map), accept, major_issues (an array) and required_experiments."""
    none = F.col("scores").isNull()
    return messages(
        (empty(F.col("time_scope")), "missing time_scope"),
        (none, "missing scores object"),
        *((~none & ~F.coalesce(F.map_contains_key("scores", F.lit(k)), F.lit(False)), f"missing scores.{k}") for k in ("novelty", "soundness", "testability")),
        (F.col("accept").isNull(), "missing accept"),
        (F.coalesce(F.size("major_issues"), F.lit(0)) <= 0, "missing major_issues[]"),
        (empty(F.col("required_experiments")), "missing required_experiments"),
    )


def mm_review_errors(items: str = "items") -> Column:
    """Of reviews whose items have page, verdict, rationale, vlm_caption, tables_md and equations_md."""

    def one(x: Column) -> Column:
        return messages(
            (x["page"].isNull(), "missing page"),
            (empty(x["verdict"]), "missing verdict"),
            (empty(x["rationale"]), "missing rationale"),
            (empty(x["vlm_caption"]) & empty(x["tables_md"]) & empty(x["equations_md"]), "provide at least one of vlm_caption/tables_md/equations_md"),
            (~F.coalesce(F.trim(x["verdict"]), F.lit("")).isin(*MM_VERDICTS), "invalid verdict"),
        )

    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.array(F.lit("items[] must be a non-empty list"))).otherwise(_each(items, "item", one))


def correction_errors(corrections: str = "corrections") -> Column:
    """Of documents whose corrections have assertion_id, rationale, corrected_time and original_time (start, end, granularity)."""

    def one(c: Column) -> Column:
        new, old = c["corrected_time"], c["original_time"]
        bare = new.isNull() | (empty(new["start"]) & empty(new["end"]) & empty(new["granularity"]))
        return messages(
            (empty(c["assertion_id"]), "missing assertion_id"),
            (empty(c["rationale"]), "missing rationale"),
            (bare, "missing corrected_time object"),
            (~bare & empty(new["granularity"]), "corrected_time.granularity required"),
            (~bare & empty(new["start"]) & empty(new["end"]), "corrected_time must include start and/or end"),
            *((~bare & ~empty(new[k]) & no_time(new[k]), f"invalid corrected_time.{k}") for k in ("start", "end")),
            *((~empty(old[k]) & no_time(old[k]), f"invalid original_time.{k}") for k in ("start", "end")),
        )

    return F.when(F.coalesce(F.size(corrections), F.lit(0)) <= 0, F.array(F.lit("corrections[] must be a non-empty list"))).otherwise(_each(corrections, "correction", one))
