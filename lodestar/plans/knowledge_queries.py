"""Queries over terms and co-occurrence edges of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import knowledge as G
from lodestar.operators.tables import staged
from lodestar.plans.registry import query, table
from lodestar.plans.text_queries import STOP_SQL

# RAKE terms, and the edges and frequencies over them, as common table expressions.
TERMS_SQL = f"""
papers AS (SELECT doc_id AS paper_id, CAST(2015 + doc_id % 10 AS INT) AS year, text FROM documents),
runs AS (SELECT paper_id, list_filter(list_transform(string_split(array_to_string(list_transform(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\-]+'),
  lambda w: CASE WHEN list_contains({STOP_SQL}, w) OR length(w) < 3 THEN '|' ELSE w END), ' '), '|'), lambda r: trim(r)), lambda r: r <> '') AS r FROM papers),
phrases AS (SELECT paper_id, unnest(range(0, len(r))) AS pos, list_slice(string_split(unnest(r), ' '), 1, 4) AS words FROM runs),
word_score AS (SELECT paper_id, word, (sum(others) + count(*)) / count(*) AS s FROM (SELECT paper_id, unnest(words) AS word, len(words) - 1 AS others FROM phrases) GROUP BY paper_id, word),
firsts AS (SELECT paper_id, array_to_string(words, ' ') AS term, min(pos) AS first_pos FROM phrases GROUP BY paper_id, term),
scored AS (SELECT f.paper_id, term, first_pos, round(CASE WHEN length(term) < 3 THEN sum(s) * 0.5 ELSE sum(s) END, 6) AS score FROM (SELECT paper_id, term, first_pos, unnest(string_split(term, ' ')) AS word FROM firsts) f JOIN word_score w ON f.paper_id = w.paper_id AND f.word = w.word GROUP BY f.paper_id, term, first_pos),
terms AS (SELECT paper_id, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, first_pos) AS rank FROM scored) WHERE rank <= 25)"""

EDGES_SQL = TERMS_SQL + r""",
whole AS (SELECT paper_id, year, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS w FROM papers),
parts AS (SELECT paper_id, year, w, list_filter(list_transform(string_split(w, '.'), lambda x: trim(x)), lambda x: length(x) >= 20) AS p FROM whole),
lines AS (SELECT paper_id, year, unnest(range(0, len(s))) AS line, unnest(s) AS sentence FROM (SELECT paper_id, year, CASE WHEN len(p) > 0 THEN p ELSE list_filter([w], lambda x: x <> '') END AS s FROM parts)),
inside AS (SELECT l.paper_id, l.year, l.line, t.term FROM lines l JOIN terms t ON l.paper_id = t.paper_id AND contains(l.sentence, t.term)),
pairs AS (SELECT a.paper_id, a.year, a.term AS source, b.term AS target, count(*) AS n FROM inside a JOIN inside b ON a.paper_id = b.paper_id AND a.line = b.line AND a.term < b.term GROUP BY ALL)"""

SCORED_SQL = EDGES_SQL + """,
freq AS (SELECT term, count(DISTINCT paper_id) AS doc_freq FROM terms GROUP BY term),
years AS (SELECT max(year) AS max_year, count(DISTINCT year) AS n_years FROM pairs),
docs_n AS (SELECT greatest(1, count(DISTINCT paper_id)) AS n_docs FROM terms),
agg AS (SELECT source, target, sum(n) AS total_count, count(DISTINCT paper_id) AS papers, sum(CASE WHEN year > max_year - 3 THEN n ELSE 0 END) AS recent, max(n_years) AS n_years FROM pairs, years GROUP BY source, target),
feat AS (SELECT a.source, a.target, a.total_count, a.papers, fu.doc_freq AS du, fv.doc_freq AS dv, n_docs, ln(CAST(a.papers AS DOUBLE) * n_docs / (fu.doc_freq * fv.doc_freq) + 1e-9) AS pmi,
  a.recent / greatest(a.total_count, 1) - 3.0 / greatest(a.n_years, 1) AS trend, ln(1 + CAST(a.total_count AS DOUBLE)) AS log_count FROM agg a JOIN freq fu ON a.source = fu.term JOIN freq fv ON a.target = fv.term, docs_n)"""


@query("rake_terms", f"WITH {TERMS_SQL} SELECT paper_id, term, score, CAST(rank AS INT) AS rank FROM terms")
def rake_terms(spark, sf_dir):
    return G.rake_terms(G.papers_of(table(spark, sf_dir, "documents")))


def _found(spark, sf_dir):
    """Co-occurrences and terms; both are read several times, so they are written once."""
    papers = G.papers_of(table(spark, sf_dir, "documents"))
    terms = staged(G.rake_terms(papers), "terms")
    return staged(G.cooccurrences(papers, terms), "cooccurrences"), terms


@query("cooccurrence_edges", f"WITH {EDGES_SQL} SELECT source, target, sum(n) AS total_count, count(DISTINCT paper_id) AS papers FROM pairs GROUP BY source, target")
def cooccurrence_edges(spark, sf_dir):
    return G.edges_of(_found(spark, sf_dir)[0])


@query("edge_yearly_counts", f"WITH {EDGES_SQL} SELECT source, target, year, sum(n) AS n FROM pairs GROUP BY source, target, year")
def edge_yearly_counts(spark, sf_dir):
    return G.yearly(_found(spark, sf_dir)[0])


@query("node_doc_freq", f"WITH {TERMS_SQL} SELECT term, count(DISTINCT paper_id) AS doc_freq FROM terms GROUP BY term")
def node_doc_freq(spark, sf_dir):
    return G.node_frequency(G.rake_terms(G.papers_of(table(spark, sf_dir, "documents"))))


@query("node_yearly_doc_freq", f"WITH {TERMS_SQL} SELECT term, year, count(DISTINCT t.paper_id) AS n FROM terms t JOIN papers p ON t.paper_id = p.paper_id GROUP BY term, year")
def node_yearly_doc_freq(spark, sf_dir):
    papers = G.papers_of(table(spark, sf_dir, "documents"))
    return G.rake_terms(papers).join(papers.select("paper_id", "year"), "paper_id").groupBy("term", "year").agg(F.countDistinct("paper_id").alias("n"))


@query("scored_edges", f"WITH {SCORED_SQL} SELECT source, target, total_count, papers, round(pmi, 6) AS pmi, round(trend, 6) AS trend, round(log_count + 0.75 * pmi + 1.25 * trend + 0.2, 6) AS score FROM feat")
def scored_edges(spark, sf_dir):
    return G.scored_edges(*_found(spark, sf_dir)).select("source", "target", "total_count", "papers", F.round("pmi", 6).alias("pmi"), F.round("trend", 6).alias("trend"), F.round("score", 6).alias("score"))


@query("top_edges", f"WITH {SCORED_SQL} SELECT source, target, total_count, round(log_count + 0.75 * pmi + 1.25 * trend + 0.2, 6) AS score FROM feat ORDER BY score DESC, source, target LIMIT 20")
def top_edges(spark, sf_dir):
    rows = G.scored_edges(*_found(spark, sf_dir)).select("source", "target", "total_count", F.round("score", 6).alias("score"))
    return rows.orderBy(F.desc("score"), "source", "target").limit(20)


@query("assertion_scores", f"""WITH {SCORED_SQL},
deg AS (SELECT node, count(*) AS deg FROM (SELECT source AS node FROM feat UNION ALL SELECT target FROM feat) GROUP BY node),
mx AS (SELECT max(total_count) AS max_tc, max(greatest(du, dv)) AS max_df FROM feat),
f AS (SELECT source, target, ln(1 + CAST(total_count AS DOUBLE)) / ln(1 + CAST(max_tc AS DOUBLE)) AS f0, ((1 - ln(1 + CAST(du AS DOUBLE)) / ln(1 + CAST(max_df AS DOUBLE))) + (1 - ln(1 + CAST(dv AS DOUBLE)) / ln(1 + CAST(max_df AS DOUBLE)))) / 2 AS f1,
  papers / n_docs AS f6, CASE WHEN ds.deg > 1 AND dt.deg > 1 THEN 1.0 WHEN ds.deg > 1 OR dt.deg > 1 THEN 0.5 ELSE 0.0 END AS f8, 1 / (1 + exp(-pmi)) AS f9,
  ln(1 + CAST(papers AS DOUBLE)) / ln(1 + CAST((SELECT max(papers) FROM feat) AS DOUBLE)) AS f5 FROM feat JOIN deg ds ON source = ds.node JOIN deg dt ON target = dt.node, mx)
SELECT source, target, round(f0, 6) AS redundancy, round(f1, 6) AS specificity, f8 AS integration, round(1 / (1 + exp(-(-4.5 + 1.5 * f0 + 0.8 * f1 + 1.2 * 0.05 + 0.3 * 0.4 + 1.0 + 0.7 * f5 + f6 + 0.5 + 0.6 * f8 + 0.4 * f9))), 6) AS quality_score FROM f
""")
def assertion_scores(spark, sf_dir):
    edges = G.scored_edges(*_found(spark, sf_dir)).withColumns({"predicate": F.lit("cooccurs_with"), "evidence_overlap": F.lit(1.0), "evidence_count": F.col("papers"), "polarity_clarity": F.lit(1.0)})
    out = G.assertion_scores(edges)
    return out.select("source", "target", F.round("f0", 6).alias("redundancy"), F.round("f1", 6).alias("specificity"), F.col("f8").alias("integration"), F.round("quality_score", 6).alias("quality_score"))
