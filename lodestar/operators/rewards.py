"""Reward components of completions, each a column between -1 and 1, from JSON that may be cut short."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import text as T

# Keys that each family's answers should have, and the values of partial answers.
SCHEMA_KEYS = {
    "trajectory_reasoning_rl": ("inference", "next_question", "extracted_assertions"),
    "assertion_review_rl": ("verdict", "rationale"),
    "mm_review_rl": ("mm_verdict", "verdict", "rationale"),
    "temporal_fix_rl": ("start_date", "end_date", "valid_from", "valid_to", "time_source"),
    "image_label_rl": ("label",),
}
REVIEWS = ("assertion_review_rl", "mm_review_rl")
JUDGED = (*REVIEWS, "temporal_fix_rl")
TEMPORAL = ("start_date", "end_date", "valid_from", "valid_to", "time_source")
VERDICT_WORDS = ("accept", "reject", "revise", "yes", "no", "true", "false")
TRIPLE = "struct<subject:string,predicate:string,object:string,start_date:string,end_date:string,time:struct<start:string,end:string>,evidence:struct<source:string,locator:string,snippet_or_summary:string>>"


def _any(tests) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _sum(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def parsed(completion: Column) -> Column:
    """The completion, without a code fence, if it is a JSON object, else null."""
    body = T.strip(F.regexp_replace(F.coalesce(completion, F.lit("")), r"^\s*```(?:json)?|```\s*$", ""))
    return F.when(body.startswith("{") & F.try_parse_json(body).isNotNull(), body)


def field(json: Column, *names: str) -> Column:
    """The first of these top-level fields that is not blank, as text."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(json, f"$.{n}")), F.lit("")) for n in names))


def partial_progress(completion: Column, family: Column) -> Column:
    """-1 to 0.25 for what a completion shows of an answer although it may not parse."""
    text = F.trim(F.coalesce(completion, F.lit("")))
    low = F.lower(text)
    score = F.lit(-1.0)
    for weight, test in (
        (0.15, text.contains("{") | text.contains("[")),
        (0.10, text.contains("}") | text.contains("]")),
        (0.05, text.contains('"') | text.contains("'")),
        (0.05, text.startswith("{") | text.startswith("[") | text.startswith("```")),
        (0.10, family.isin(*JUDGED) & _any(low.contains(w) for w in VERDICT_WORDS)),
    ):
        score = score + F.when(test, weight).otherwise(0.0)
    keys = F.lit(0.0)
    for name, wanted in SCHEMA_KEYS.items():
        keys = F.when(family == name, F.least(F.lit(0.45), 0.15 * _sum(low.contains(k).cast("int") for k in wanted))).otherwise(keys)
    return F.when(text == "", -1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(0.25), score + keys)))


def partial_fields(completion: Column, keys: tuple[str, ...], empty: float) -> Column:
    """``empty`` and 0.15 for each key that the text names, -0.05 at most."""
    low = F.lower(F.trim(F.coalesce(completion, F.lit(""))))
    n = _sum(low.contains(k).cast("int") for k in keys)
    return F.when(n > 0, F.least(F.lit(-0.05), empty + 0.15 * n)).otherwise(empty)


def schema_validity(completion: Column, family: Column) -> Column:
    json = parsed(completion)
    has = lambda k: F.get_json_object(json, f"$.{k}").isNotNull()
    whole = (
        ((family == "trajectory_reasoning_rl") & reduce(lambda a, b: a & b, (has(k) for k in SCHEMA_KEYS["trajectory_reasoning_rl"])))
        | (family.isin(*REVIEWS) & (has("verdict") | has("mm_verdict")))
        | ((family == "temporal_fix_rl") & _any(has(k) for k in TEMPORAL))
    )
    return F.when(json.isNull(), partial_progress(completion, family)).when(whole, 1.0).otherwise(0.5)


def label_match(completion: Column, label: Column, family: Column) -> Column:
    got = T.norm(F.coalesce(field(parsed(completion), "label", "reference_label", "label_text"), completion, F.lit("")))
    want = T.norm(label)
    scored = F.when(got == want, 1.0).when(F.contains(got, want), 0.5).otherwise(-1.0)
    return F.when((family == "image_label_rl") & (F.coalesce(want, F.lit("")) != ""), scored).otherwise(0.0)


def assertions(json: Column) -> Column:
    """The assertions of an answer, wherever it holds them; an answer that is one itself."""
    listed = [F.from_json(F.get_json_object(json, f"$.{path}"), f"array<{TRIPLE}>") for path in ("assertions", "extracted_assertions", "prediction.assertions", "prediction.extracted_assertions")]
    alone = F.when(field(json, "subject").isNotNull() & field(json, "predicate").isNotNull() & field(json, "object").isNotNull(), F.array(F.from_json(json, TRIPLE)))
    return F.coalesce(*listed, alone, F.array().cast(f"array<{TRIPLE}>"))


def triple_keys(rows: Column) -> Column:
    """Different keys of subject, predicate, object, start and end."""
    norm = lambda c: T.norm(F.coalesce(c, F.lit("")))
    first = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    return F.array_distinct(F.transform(rows, lambda x: F.concat_ws("|", norm(x["subject"]), norm(x["predicate"]), norm(x["object"]), norm(first(x["start_date"], x["time"]["start"])), norm(first(x["end_date"], x["time"]["end"])))))


def graph_consistency(completion: Column, reference: Column, family: Column) -> Column:
    """2 F1 - 1 over different five-field keys of a trajectory's assertions."""
    got, want = triple_keys(assertions(parsed(completion))), triple_keys(F.coalesce(F.from_json(reference, f"array<{TRIPLE}>"), F.array().cast(f"array<{TRIPLE}>")))
    f1 = 2.0 * F.size(F.array_intersect(got, want)) / (F.size(got) + F.size(want))
    scored = F.when(F.size(got) == 0, F.when(F.size(want) > 0, -1.0).otherwise(0.0)).when(F.size(want) == 0, -0.25).otherwise(2.0 * f1 - 1.0)
    return F.when(family == "trajectory_reasoning_rl", scored).otherwise(0.0)


def temporal_consistency(completion: Column, reference: Column, family: Column) -> Column:
    """Share of the known fields of the reference that the answer gives alike."""
    json = parsed(completion)
    own = F.coalesce(F.nullif(F.get_json_object(json, "$.corrected_temporal"), F.lit("")), json)
    known = [F.get_json_object(reference, f"$.{k}") for k in TEMPORAL]
    asked = [F.coalesce(~x.isin("", "unknown"), F.lit(False)) for x in known]
    alike = [ok & (T.norm(F.coalesce(F.get_json_object(own, f"$.{k}"), F.lit(""))) == T.norm(x)) for k, x, ok in zip(TEMPORAL, known, asked, strict=True)]
    total = _sum(a.cast("int") for a in asked)
    share = F.when(total > 0, _sum(a.cast("int") for a in alike) / total).otherwise(0.0)
    return F.when(~family.isin("assertion_review_rl", "temporal_fix_rl"), 0.0).when(json.isNull(), -1.0).otherwise(share)


def evidence_presence(completion: Column, family: Column) -> Column:
    json = parsed(completion)
    named = lambda c: F.coalesce(~F.trim(c).isin("", "unknown"), F.lit(False))
    cited = F.exists(assertions(json), lambda a: named(a["evidence"]["source"]) | named(a["evidence"]["locator"]) | named(a["evidence"]["snippet_or_summary"]))
    scored = (
        F.when(family == "trajectory_reasoning_rl", F.when(cited, 1.0).otherwise(-0.25))
        .when(family.isin(*REVIEWS), F.when(field(json, "rationale", "mm_rationale").isNotNull(), 1.0).otherwise(-0.25))
        .when(family == "temporal_fix_rl", F.when(field(json, "comment").isNotNull(), 0.5).otherwise(0.0))
        .otherwise(0.0)
    )
    return F.when(family == "image_label_rl", 0.0).when(json.isNull(), partial_fields(completion, ("evidence", "rationale", "snippet", "source"), -0.5)).otherwise(scored)


# What verdicts are called; a word of several words counts inside a text too.
VERDICTS = {
    "accept": ("accept", "accepted", "valid", "supported", "true", "correct", "ok", "approve", "approved"),
    "reject": ("reject", "rejected", "invalid", "unsupported", "false", "incorrect", "wrong", "deny", "denied"),
    "revise": ("revise", "revision", "needs revision", "fix", "modify", "partial"),
}


def canonical_verdict(value: Column) -> Column:
    """accept, reject, revise, unknown if there is none, or the text itself."""
    text = F.regexp_replace(T.norm(F.coalesce(value, F.lit(""))), "[_-]", " ")
    about = text.contains("support") | text.contains("valid") | text.contains("correct")
    out = F.when(text == "", "unknown")
    for name, words in VERDICTS.items():
        out = out.when(text.isin(*words), name)
    return out.when((text.startswith("un") | text.contains("not")) & about, "reject").when(text.contains("needs revision"), "revise").otherwise(text)


def opposite(verdict: Column) -> Column:
    return F.when(verdict == "accept", "reject").when(verdict.isin("reject", "revise"), "accept").otherwise("unknown")


def override_match(completion: Column, expected: Column, family: Column) -> Column:
    """How an answer's verdict agrees with the expert's, more if it gives a reason."""
    json, want = parsed(completion), canonical_verdict(expected)
    got_raw = F.when(family == "mm_review_rl", field(json, "mm_verdict", "verdict")).otherwise(field(json, "verdict", "expected_verdict"))
    got, reasoned = canonical_verdict(got_raw), field(json, "rationale", "mm_rationale", "comment").isNotNull()
    named = F.contains(T.norm(F.coalesce(completion, F.lit(""))), want)
    whole = F.when(got == want, F.when(reasoned, 1.0).otherwise(0.75)).when(got.isin("accept", "reject", "revise"), -0.55).when(named, 0.15).otherwise(-0.9)
    cut = F.when((canonical_verdict(completion) == want) | named, 0.35).otherwise(partial_fields(completion, ("verdict", "mm_verdict"), -0.75))
    return F.when(family.isin(*JUDGED), F.when(json.isNull(), cut).otherwise(whole)).otherwise(0.0)
