"""Which paper an entry, a source or an asset belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.functions import keys as K
from lodestar.functions import text as T
from lodestar.operators.matching import sequence_ratio

#: A candidate below this score is no match.
LEAST = 1.75


def identity_keys(ref: Column, title: Column) -> Column:
    """All keys under which an entry may be known: its identifiers, its address with and without .pdf, its title."""
    ref, title = F.coalesce(F.trim(ref), F.lit("")), F.coalesce(F.trim(title), F.lit(""))
    named = lambda kind, value: F.when(value != "", F.concat(F.lit(f"{kind}:"), F.lower(value)))
    is_url = ref.rlike("(?i)^[a-z][a-z0-9+.-]*://[^/]")
    url = F.when(is_url, K.url_canonical(ref))
    keys = F.array(
        named("doi", K.doi(ref)),
        named("arxiv", K.arxiv(ref)),
        named("pmcid", K.pmcid(ref)),
        F.when(~is_url, named("pmid", K.pmid(ref))),
        url,
        F.regexp_replace(url, r"(?i)\.pdf$", ""),
        F.when(title != "", F.concat(F.lit("title:"), T.title_key(title))),
    )
    return F.array_distinct(F.array_compact(keys))


def primary_key(ref: Column, title: Column) -> Column:
    """The first identifier of an entry, else its address, its title or the reference itself."""
    ref, title = F.coalesce(F.trim(ref), F.lit("")), F.coalesce(F.trim(title), F.lit(""))
    named = lambda kind, value: F.when(value != "", F.concat(F.lit(f"{kind}:"), F.lower(value)))
    is_url = ref.rlike("(?i)^[a-z][a-z0-9+.-]*://[^/]")
    return F.coalesce(
        named("doi", K.doi(ref)), named("arxiv", K.arxiv(ref)), named("openalex", K.openalex(ref)), named("pmcid", K.pmcid(ref)),
        F.when(~is_url, named("pmid", K.pmid(ref))), F.when(is_url, F.regexp_replace(K.url_canonical(ref), r"(?i)\.pdf$", "")),
        F.when(title != "", F.concat(F.lit("title:"), T.title_key(title))), F.concat(F.lit("raw:"), ref),
    )


def candidate_score(title: Column, year: Column, ref: Column, paper: dict[str, Column]) -> Column:
    """4 times the title ratio, nearness of the years, 5 for the same DOI or id, 4 for the same arXiv or OpenAlex id, a little for a PDF and an abstract."""
    a, b = T.title_key(F.coalesce(title, F.lit(""))), T.title_key(F.coalesce(paper["title"], F.lit("")))
    ratio = F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(sequence_ratio(a, b))
    same = lambda x, y: F.coalesce((x != "") & (F.lower(x) == F.lower(y)), F.lit(False))
    score = 4.0 * ratio + F.coalesce(F.greatest(F.lit(0.0), 1.0 - 0.25 * F.abs(year - paper["year"])), F.lit(0.0))
    for weight, test in ((5.0, same(K.doi(ref), paper["doi"])), (4.0, same(K.arxiv(ref), paper["arxiv"])), (4.0, same(K.openalex(ref), paper["openalex"])), (5.0, same(ref, paper["id"]))):
        score = score + F.when(test, weight).otherwise(0.0)
    return score + F.when(paper["pdf_url"].isNotNull(), 0.25).otherwise(0.0) + F.when(paper["abstract"].isNotNull(), 0.1).otherwise(0.0)


def best_candidates(entries: DataFrame, candidates: DataFrame, least: float = LEAST) -> DataFrame:
    """(entry_id, id, score): per entry the candidate of the best score, the first of equal ones, if it reaches ``least``.

    ``entries``: entry_id, ref, title, year; ``candidates``: entry_id, pos and
    the columns of a paper, as a search for the entry gave them.
    """
    papers = candidates.select("entry_id", "pos", *(F.col(c).alias(f"c_{c}") for c in ("id", "title", "year", "doi", "arxiv", "openalex", "pdf_url", "abstract")))
    joined = entries.join(papers, "entry_id")
    paper = {c: F.col(f"c_{c}") for c in ("id", "title", "year", "doi", "arxiv", "openalex", "pdf_url", "abstract")}
    scored = joined.select("entry_id", "pos", F.col("c_id").alias("id"), candidate_score(F.col("title"), F.col("year"), F.col("ref"), paper).alias("score"))
    best = scored.groupBy("entry_id").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("pos"))).alias("b"))
    return best.select("entry_id", "b.id", "b.score").where(F.col("score") >= least)


def resolved(entries: DataFrame, papers: DataFrame) -> DataFrame:
    """(entry_id, id): entries and papers that share an identity key; the first paper of an entry, and every paper once, with its first entry.

    ``entries``: entry_id, ref, title; ``papers``: pos, id, title.  Keys meet by
    equality, and a hot key is summed up to its first paper before it is joined.
    """
    known = papers.select("pos", "id", F.explode(identity_keys(F.col("id"), F.col("title"))).alias("key")).groupBy("key").agg(F.min_by("id", "pos").alias("id"), F.min("pos").alias("pos"))
    asked = entries.select("entry_id", F.explode(identity_keys(F.col("ref"), F.col("title"))).alias("key"))
    first = asked.join(known, "key").groupBy("entry_id").agg(F.min_by("id", "pos").alias("id"))
    return first.groupBy("id").agg(F.min("entry_id").alias("entry_id")).select("entry_id", "id")


def source_years(sources: DataFrame, papers: DataFrame) -> DataFrame:
    """(source_id, year): the year of the paper that a source names, by the first of its keys that is known with a year.

    ``sources``: source_id, ref; ``papers``: pos, id, title, year.  Of papers
    under one key the last counts.
    """
    doi_of = lambda c: F.nullif(K.doi(c), F.lit(""))
    own = F.array_distinct(F.array_compact(F.array(F.nullif(F.trim("id"), F.lit("")), doi_of(F.col("id")), F.concat(F.lit("doi:"), doi_of(F.col("id"))), F.nullif(T.title_key("title"), F.lit("")))))
    known = papers.select("pos", "year", F.explode(own).alias("key")).groupBy("key").agg(F.max_by("year", "pos").alias("year")).where("year IS NOT NULL")
    ref = F.trim("ref")
    arxiv, alex = F.nullif(K.arxiv(ref), F.lit("")), F.nullif(K.openalex(ref), F.lit(""))
    asked = F.array_compact(F.array(ref, doi_of(ref), F.concat(F.lit("doi:"), doi_of(ref)), arxiv, F.concat(F.lit("arxiv:"), arxiv), alex, F.concat(F.lit("openalex:"), alex), F.nullif(T.title_key(ref), F.lit(""))))
    return sources.select("source_id", F.posexplode(asked).alias("place", "key")).join(known, "key").groupBy("source_id").agg(F.min_by("year", "place").alias("year"))


def step_windows(steps: DataFrame, sources: DataFrame, years: DataFrame) -> DataFrame:
    """(step_id, start_date, end_date): first and last year of the papers that a step's sources name, unknown without any."""
    found = sources.select("step_id", "source_id").join(years, "source_id").groupBy("step_id").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    date = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return steps.select("step_id").distinct().join(found, "step_id", "left").select("step_id", date("a").alias("start_date"), date("b").alias("end_date"))


def case_scores(cases: DataFrame, rows: DataFrame, near: int = 2) -> DataFrame:
    """(case_id, row_id, score): per case the row of the same signature with the best score, the first of equal ones.

    100 for the signature, 6 for the rank that the case hints at, 3 for one
    within ``near`` of it.  Ranks meet by equality, a case looking for the few
    around its hint, and what no rank reaches is the first row of the signature;
    so a signature of very many cases and rows makes no pairs of them all.

    ``cases``: case_id, signature, hint; ``rows``: row_id, signature, rank.
    """
    firsts = rows.groupBy("signature").agg(F.min("row_id").alias("row_id"))
    plain = cases.select("case_id", "signature").join(firsts, "signature").select("case_id", "row_id", F.lit(100).alias("score"))
    by_rank = rows.groupBy("signature", "rank").agg(F.min("row_id").alias("row_id"))
    around = cases.where("hint IS NOT NULL").select("case_id", "signature", F.explode(F.sequence(F.lit(-near), F.lit(near))).alias("off"), "hint")
    ranked = around.select("case_id", "signature", "off", (F.col("hint") + F.col("off")).alias("rank")).join(by_rank, ["signature", "rank"])
    ranked = ranked.select("case_id", "row_id", F.when(F.col("off") == 0, 106).otherwise(103).alias("score"))
    best = plain.unionByName(ranked).groupBy("case_id").agg(F.max_by(F.struct("row_id", "score"), F.struct("score", -F.col("row_id"))).alias("b"))
    return best.select("case_id", "b.row_id", "b.score")


def asset_scores(assets: DataFrame, cases: DataFrame, gate: str) -> DataFrame:
    """(case_id, asset_id, score) of the assets and cases that share ``gate``.

    10 for each identifier of the paper in the asset's name, 1 for each word of
    five letters or more of the title, 5 for each label of a figure or table, 3
    for each page.  ``assets``: asset_id, gate, name; ``cases``: case_id, gate,
    paper_ids, title, labels, pages.
    """
    squeeze = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    name = F.lower("name")
    both = assets.join(cases, gate)
    words = F.filter(F.split(F.lower("title"), "[^a-zA-Z0-9]+"), lambda w: (F.length(w) >= 5) & F.contains(name, w))
    ids = F.filter("paper_ids", lambda c: (T.slug(c) != "") & F.contains(T.slug(name), T.slug(c)))
    labels = F.filter("labels", lambda x: (squeeze(x) != "") & F.contains(squeeze(name), squeeze(x)))
    pages = F.filter("pages", lambda p: F.exists(F.regexp_extract_all(name, F.lit(r"(?:page|p|_)0*([0-9]+)(?:\D|$)"), F.lit(1)), lambda n: n.cast("int") == p))
    score = 10 * F.size(ids) + F.size(words) + 5 * F.size(labels) + 3 * F.size(pages)
    return both.select("case_id", "asset_id", score.alias("score"))


def best_assets(scores: DataFrame, most: int) -> DataFrame:
    """(case_id, place, asset_id, score): the ``most`` best assets of each case that score at all."""
    place = F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("score"), "asset_id"))
    return scores.where("score > 0").withColumn("place", place).where(F.col("place") <= most).select("case_id", "place", "asset_id", "score")


def image_records(selected: DataFrame, pool: DataFrame, most: int) -> DataFrame:
    """(key, place, record_id): images of a sample: those selected in their order, then others of the pool, ``most`` at most (0: all).

    Both: key, record_id, has_image, modality, page.  Order: images first,
    figures and tables, then pages, then the rest; by page, those without last.
    """
    def order(extra: int):
        kind = F.when(F.col("modality").isin("figure", "table"), 0).when(F.col("modality") == "page", 1).otherwise(2)
        return F.struct(F.lit(extra).alias("extra"), kind.alias("kind"), F.coalesce("page", F.lit(10_000)).alias("page"), F.col("record_id").alias("id"))

    both = selected.where("has_image").select("key", "record_id", order(0).alias("at")).unionByName(pool.where("has_image").select("key", "record_id", order(1).alias("at")))
    once = both.groupBy("key", "record_id").agg(F.min("at").alias("at"))
    placed = once.withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("at")))
    return (placed.where(F.col("place") <= most) if most else placed).select("key", "place", "record_id")
