"""Exclusion specs, relation families, noise tests, triage and gates as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import keys as K
from lodestar.functions import text as T

# Keys under which an exclusion spec may list each kind of rule.
SPEC_KEYS = {
    "ids": ("paper_ids", "paper_id", "papers", "articles", "ids", "identifier", "identifiers", "doi", "dois"),
    "titles": ("titles", "paper_titles", "article_titles"),
    "refs": ("source_refs", "source_ref", "sources", "urls", "pdf_urls", "links"),
    "substrings": ("match_substrings", "contains", "substrings", "paper_id_contains", "title_contains", "url_substrings", "source_contains", "link_contains"),
}
# Predicates that carry no or much scientific meaning, and entities too generic to mean anything.
JUNK_PREDICATES = (
    "is_estimated_to", "is_segmented_into", "consists_of", "was_carried_out_during", "was_destroyed_after_experiment",
    "calculated_at", "provide_comments", "assist_research", "acknowledges", "thanks", "is_cited_by", "is_referenced_in",
    "is_described_in", "is_shown_in", "is_listed_in", "is_defined_as", "is_denoted_by", "is_abbreviated_as", "is_equal_to",
    "is_written_as", "is_formatted_as",
)
GOOD_PREDICATES = (
    "causes", "leads_to", "results_in", "improves", "reduces", "increases", "decreases", "affects", "influences",
    "predicts", "estimates", "quantifies", "outperforms", "enables", "prevents", "inhibits", "promotes", "mediates",
    "drives", "induces", "depends_on", "requires", "assumes", "violates", "supports", "contradicts", "extends",
    "generalizes", "refines", "applied_to", "used_for", "combined_with", "compared_to", "uses", "incorporates", "measures",
    "involves", "allows", "are_used_for", "is_used_for", "used_in", "is_computed_from", "is_determined_by",
    "is_measured_by", "arises_from", "rely_on", "relies_on", "manages", "maximizes", "minimizes", "affect", "reflects",
    "addresses", "accounts_for", "overcomes", "mitigates", "captures", "leverages",
)
GENERIC_ENTITIES = (
    "model", "method", "approach", "result", "results", "data", "features", "study", "paper", "analysis", "research",
    "experiment", "system", "process", "problem", "solution", "value", "values", "variable", "variables", "parameter",
    "parameters", "function", "performance", "information", "useful", "important", "significant", "different",
)
# What numbers, formulas and references to parts of a paper look like, and thanks and notices in evidence.
NOISE_ENTITY = (
    r"(?i)^([0-9][0-9.,/%\s]*$|[0-9.,]+\s*(percent|samples|decile)|∂.*[/=]|\(?[0-9]+\)?$|[a-z]\(\w\)|eq\.?\s*[0-9]|table\s*[0-9]"
    r"|figure\s*[0-9]|fig\.\s*[0-9]|appendix\s*[a-z]|p\s*[<>=]\s*[0-9.])"
)
NOISE_EVIDENCE = r"(?i)(thank\w*\s+(the|our|my)|acknowledg|seminar\s+participant|workshop\s+participant|anonymous\s+referee|anonymous\s+reviewer|copyright\s*©|©\s*[0-9]{4})"
#: Words of a predicate by which its family is known; the first that holds.
FAMILIES = {
    "cooccurrence": r"co-?occur",
    "causal": r"caus|lead|result|induce|trigger|drive|prevent|inhibit|promote|depend",
    "comparative": r"improve|reduce|increase|decrease|outperform|compare",
    "temporal": r"precede|follow|before|after|during",
    "taxonomic": r"is_a|type_of|part_of|consist",
}


def exclusion_rules(spec: Mapping | list | None) -> dict:
    """Rules of a spec whatever its keys are called: ids, titles, refs and substrings in lower case, and max_year."""
    doc = {"ids": spec} if isinstance(spec, list) else dict(spec or {})
    for name in ("task2_exclusions", "exclusions", "exclude_articles"):
        if doc.get(name):
            inner = doc[name]
            doc = {"ids": inner} if isinstance(inner, list) else dict(inner)
            break
    out: dict = {}
    for kind, names in SPEC_KEYS.items():
        found: list[str] = []
        for name in names:
            value = doc.get(name)
            found += [str(v).strip().lower() for v in (value if isinstance(value, (list, tuple, set)) else [] if value is None else [value])]
        out[kind] = sorted({v for v in found if v})
    years = doc.get("years")
    year = doc.get("max_year", years.get("max") if isinstance(years, Mapping) else None)
    out["max_year"] = int(year) if str(year if year is not None else "").strip().lstrip("-").isdigit() else None
    return out


def excluded(rules: dict, ids: Column, titles: Column, refs: Column, year: Column | None = None) -> Column:
    """Whether a row matches any rule: its year, an identifier in any spelling, a title, or a part of its texts.

    ``ids``, ``titles`` and ``refs`` are arrays of strings.  Parts are sought
    in all texts together, so an identifier also excludes those it begins.
    """
    tests: list[Column] = []
    if rules["max_year"] is not None and year is not None:
        tests.append(F.coalesce(year > rules["max_year"], F.lit(False)))
    spellings = F.flatten(F.transform(F.concat(ids, refs), lambda x: F.array(F.lower(F.trim(x)), F.regexp_replace(F.lower(F.trim(x)), r"^(https?://(dx\.)?doi\.org/|doi:|arxiv:|pmid:|pmcid:)", ""), K.doi(x))))
    named = [*rules["ids"], *rules["refs"]]
    if named:
        tests.append(F.arrays_overlap(spellings, F.array(*map(F.lit, named))))
    if rules["titles"]:
        own = F.transform(titles, lambda x: T.title_key(x))
        tests.append(F.exists(F.array(*(T.title_key(F.lit(t)) for t in rules["titles"])), lambda t: F.array_contains(own, t)))
    parts = [*named, *rules["titles"], *rules["substrings"]]
    if parts:
        whole = F.lower(F.array_join(F.concat(ids, titles, refs), " "))
        tests.append(F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(whole, p)))
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(False)


def family(predicate: Column) -> Column:
    """The relation family of a predicate, other if none holds."""
    text = F.lower(predicate)
    out = F.lit("other")
    for name, words in reversed(FAMILIES.items()):
        out = F.when(text.rlike(words), name).otherwise(out)
    return out


# Words of an edge that make it likely causal.
CAUSAL_WORDS = (
    "cause", "causes", "causal", "lead to", "leads to", "drives", "drive", "induces", "induce",
    "promotes", "promote", "inhibits", "inhibit", "mediates", "mediate", "results in", "trigger", "triggered by",
)


def likely_causal(*texts: Column) -> Column:
    """Whether any text of an edge has a causal word."""
    whole = F.lower(F.concat_ws(" ", *texts))
    return reduce(lambda a, b: a | b, (F.contains(whole, F.lit(w)) for w in CAUSAL_WORDS))


def cooccurrence(*texts: Column) -> Column:
    """Whether any text of an edge names a co-occurrence."""
    return F.lower(F.concat_ws(" ", *texts)).rlike("co-?occur")


def strength_of(*candidates: Column) -> Column:
    """The first candidate between 0 and 1, rounded to six places, else 0."""
    return F.coalesce(*(F.when(c.between(0.0, 1.0), F.round(c.cast("double"), 6)) for c in candidates), F.lit(0.0))


def hidden(texts: list[Column], strength: Column, mode: str, threshold: float = 0.45) -> Column:
    """Whether an edge is left out: co-occurrences in mode exclude_all; in mode hide_weak those that are weak and not likely causal; none in any other mode."""
    weak = cooccurrence(*texts)
    if mode in ("exclude_all", "drop_all", "only_non_cooccurrence"):
        return weak
    if mode in ("hide_weak", "weak_only"):
        return weak & ~likely_causal(*texts) & (strength <= max(0.0, min(1.0, threshold)))
    return F.lit(False)


def noise_entity(entity: Column) -> Column:
    text = T.norm(entity)
    return (F.length(text) < 2) | text.rlike(NOISE_ENTITY) | text.isin(*GENERIC_ENTITIES) | text.rlike(r"^\p{L}{1,2}$")


def triage(rows: DataFrame) -> DataFrame:
    """Rows with triage_score, reasons and verdict.

    Needs subject, predicate, object, snippet, importance, papers (a number)
    and quality (null if unknown).  2 or more accepts, -2 or less rejects.
    """
    s, p, o = (T.norm(F.coalesce(c, F.lit(""))) for c in ("subject", "predicate", "object"))
    snippet = T.norm(F.coalesce("snippet", F.lit("")))
    noisy = (F.length(snippet) >= 10) & snippet.rlike(NOISE_EVIDENCE)
    importance, quality = F.coalesce("importance", F.lit(0.0)), F.col("quality")
    terms = [
        ("subject is noise", noise_entity(s), -2.0),
        ("object is noise", noise_entity(o), -2.0),
        ("junk predicate", p.isin(*JUNK_PREDICATES), -3.0),
        ("evidence is no science", noisy, -2.0),
        ("self-loop", s == o, -3.0),
        ("subject too long", F.length(s) > 80, -1.5),
        ("object too long", F.length(o) > 80, -1.5),
        ("good predicate", p.isin(*GOOD_PREDICATES), 2.0),
        ("high importance", importance >= 0.3, 1.5),
        ("moderate importance", (importance >= 0.15) & (importance < 0.3), 0.5),
        ("substantive evidence", (F.length(snippet) > 30) & ~snippet.rlike(NOISE_EVIDENCE), 1.0),
        ("several papers", F.col("papers") > 1, 2.0),
        ("high quality", quality >= 0.7, 2.5),
        ("moderate quality", (quality >= 0.4) & (quality < 0.7), 1.0),
        ("low quality", (quality >= 0) & (quality < 0.2), -2.0),
    ]
    score = reduce(lambda a, b: a + b, [F.when(test, weight).otherwise(0.0) for _, test, weight in terms])
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test, _ in terms)))
    out = rows.withColumns({"triage_score": score, "reasons": reasons})
    return out.withColumn("verdict", F.when(F.col("triage_score") >= 2, "accept").when(F.col("triage_score") <= -2, "reject").otherwise("review"))


def collapsed(edges: DataFrame, least: int = 1) -> DataFrame:
    """One row per unordered pair: the largest weight, a weight of 0 counting as 1, and the attributes of the best-ranked edge.

    ``edges``: source, target, predicate, weight, total_count, edge_rank.
    Self-loops and edges below ``least`` go.
    """
    rows = edges.where((F.col("source") != F.col("target")) & (F.col("total_count") >= least))
    weight = F.max(F.when(F.col("weight") == 0, 1.0).otherwise(F.col("weight")))
    return rows.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(weight.alias("weight"), F.min_by("predicate", "edge_rank").alias("predicate"))


def with_targets(rows: DataFrame, family_column: str, targets: list[str]) -> DataFrame:
    """Rows with any target that is not null; the coverage is :func:`target_coverage`."""
    return rows.where(F.coalesce(*(F.col(t).cast("string") for t in targets)).isNotNull())


def target_coverage(rows: DataFrame, family_column: str, targets: list[str]) -> DataFrame:
    ready = F.coalesce(*(F.col(t).cast("string") for t in targets)).isNotNull()
    return rows.groupBy(family_column).agg(F.count(F.lit(1)).alias("n"), F.count_if(ready).alias("ready"), *(F.count(t).alias(f"with_{t}") for t in targets))


def rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule whose pattern occurs is applied to a text; none leaves it as it is."""
    out = text
    for pattern, replacement in reversed(rules):
        out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, replacement)).otherwise(out)
    return out
