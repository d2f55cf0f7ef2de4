"""Queries over texts, identifiers, URLs and partial dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import dates as D
from lodestar.functions import keys as K
from lodestar.functions import text as T
from lodestar.plans.registry import query, table

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query("chunk_documents", r"""
SELECT doc_id, i AS chunk, c AS text FROM (
  SELECT doc_id, unnest(range(1, len(cs) + 1)) AS i, unnest(cs) AS c FROM (
    SELECT doc_id, list_filter(list_transform(range(0, greatest(CAST(ceil(length(text) / 1200.0) AS BIGINT), 1)), lambda k: regexp_replace(substring(text, CAST(k * 1200 + 1 AS BIGINT), 1200), '^\s+|\s+$', '', 'g')), lambda c: length(c) > 0) AS cs FROM documents))
""")
def chunk_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.chunks("text")).alias("chunk", "text")).withColumn("chunk", (F.col("chunk") + 1).cast("long"))


@query("token_counts_by_document", f"""
SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\-]{{3,}}'), lambda t: NOT list_contains({STOP_SQL}, t)) AS t FROM documents)
""")
def token_counts_by_document(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("token_frequency", f"""
SELECT token, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (
  SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\-]{{3,}}'), lambda t: NOT list_contains({STOP_SQL}, t))) AS token FROM documents) GROUP BY token
""")
def token_frequency(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    per_doc = docs.select("doc_id", F.explode(T.tokens("text")).alias("token")).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("token").agg(F.sum("n").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("sentence_split", r"""
SELECT doc_id, len(s) AS n_sentences, list_aggregate(list_transform(s, lambda x: length(x)), 'max') AS longest FROM (
  SELECT doc_id, CASE WHEN len(p) > 0 THEN p ELSE list_filter([w], lambda x: x <> '') END AS s FROM (
    SELECT doc_id, w, list_filter(list_transform(string_split(w, '.'), lambda x: trim(x)), lambda x: length(x) >= 20) AS p FROM (
      SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS w FROM documents)))
""")
def sentence_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.sentences("text").alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).cast("long").alias("longest"))


@query("title_keys", r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS title_key,
  regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  CASE WHEN length(p_name) > 12 THEN regexp_replace(substring(p_name, 1, 11), '\s+$', '') || '…' ELSE p_name END AS short FROM part
""")
def title_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.title_key("p_name").alias("title_key"), T.slug("p_name").alias("slug"), T.truncate("p_name", 12).alias("short"))


@query("text_quality", r"""
SELECT doc_id, round(len(regexp_extract_all(text, '\p{L}')) / greatest(length(text), 1), 6) AS alpha_ratio,
  round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(w)) / len(w) END, 6) AS distinct_ratio, len(w) AS n_words FROM (
  SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_\-]+') AS w FROM documents)
""")
def text_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), F.lit(0)).alias("w"))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    return docs.select(
        "doc_id",
        F.round(letters / F.greatest(F.length("text"), F.lit(1)), 6).alias("alpha_ratio"),
        F.round(F.when(F.size("w") == 0, 0.0).otherwise(F.size(F.array_distinct("w")) / F.size("w")), 6).alias("distinct_ratio"),
        F.size("w").cast("long").alias("n_words"),
    )


@query("dates_and_granularity", r"""
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders)
SELECT o_orderkey, d, CASE length(d) WHEN 4 THEN 'year' WHEN 7 THEN 'month' ELSE 'day' END AS granularity, CAST(substring(d, 1, 4) AS INT) AS year,
  CASE length(d) WHEN 10 THEN CAST(substring(d, 1, 4) AS INT) * 372 + CAST(substring(d, 6, 2) AS INT) * 31 + CAST(substring(d, 9, 2) AS INT) WHEN 7 THEN CAST(substring(d, 1, 4) AS INT) * 12 + CAST(substring(d, 6, 2) AS INT) ELSE CAST(d AS INT) END AS time_number,
  CASE length(d) WHEN 4 THEN d || '-99-99' WHEN 7 THEN d || '-99' ELSE d END AS end_key, CASE length(d) WHEN 4 THEN d || '-01-01' WHEN 7 THEN d || '-01' ELSE d END AS first_day FROM s
""")
def dates_and_granularity(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    shape = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = orders.select("o_orderkey", shape.alias("d"))
    return rows.select("o_orderkey", "d", D.granularity("d").alias("granularity"), D.safe_year("d").alias("year"), D.time_number("d").alias("time_number"), D.padded("d", end=True).alias("end_key"), D.first_day("d").cast("string").alias("first_day"))


@query("years_in_pages", r"""
SELECT page_id, len(y) AS n_years, list_min(y) AS first_year, list_max(y) AS last_year FROM (SELECT page_id, regexp_extract_all(html, '\b(19[0-9]{2}|20[0-9]{2})\b', 1) AS y FROM pages)
""")
def years_in_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", D.years_in("html").alias("y"))
    return pages.select("page_id", F.size("y").cast("long").alias("n_years"), F.array_min("y").alias("first_year"), F.array_max("y").alias("last_year"))


@query("content_ids", r"""
SELECT doc_id, substring(sha1(CAST(doc_id AS VARCHAR) || '|' || coalesce(lang, '') || '|' || coalesce(text, '')), 1, 16) AS content_id,
  CASE WHEN substring(sha256(CAST(doc_id AS VARCHAR)), 8, 1) IN ('0','2','4','6','8','a','c','e') THEN 'A' ELSE 'B' END AS side,
  CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(md5(CAST(doc_id AS VARCHAR)), ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS BIGINT))), lambda a, c: (a * 16 + c) % 10000) AS BIGINT) AS bucket FROM documents
""")
def content_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    return docs.select("doc_id", K.content_id(F.col("doc_id"), F.col("lang"), F.col("text")).alias("content_id"), K.side(key).alias("side"), K.md5_bucket(key).alias("bucket"))


@query("url_forms", r"""
WITH u AS (SELECT page_id, trim(url) AS url FROM pages),
b AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS c FROM u),
v AS (SELECT page_id, c, replace(c, '://www.', '://') AS w FROM b)
SELECT page_id, c AS canonical, len(list_distinct([c, w, regexp_replace(w, '\.pdf$', ''), regexp_replace(w, '^[a-z][a-z0-9+.-]*://', '')])) AS n_variants, regexp_replace(w, '^[a-z][a-z0-9+.-]*://', '') AS bare FROM v
""")
def url_forms(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", K.url_canonical("url").alias("canonical"), K.url_variants("url").alias("v"))
    return pages.select("page_id", "canonical", F.size("v").cast("long").alias("n_variants"), F.element_at("v", -1).alias("bare"))


@query("html_links", r"""
SELECT page_id, len(l) AS n_links, len(list_distinct(l)) AS n_distinct, coalesce(l[1], '') AS first_link, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM (SELECT page_id, html, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages)
""")
def html_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html", F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)).alias("l"))
    return pages.select("page_id", F.size("l").cast("long").alias("n_links"), F.size(F.array_distinct("l")).cast("long").alias("n_distinct"), F.coalesce(F.get("l", F.lit(0)), F.lit("")).alias("first_link"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("identifier_kinds", r"""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'https://doi.org/10.1000/' || o_custkey WHEN 1 THEN 'arXiv:2101.' || lpad(CAST(o_custkey AS VARCHAR), 5, '0') WHEN 2 THEN 'PMC' || o_orderkey WHEN 3 THEN CAST(100000 + o_orderkey AS VARCHAR) WHEN 4 THEN 'W' || (10000 + o_orderkey) ELSE 'http://x.example/' || o_orderkey END AS ref FROM orders)
SELECT o_orderkey, ref, CASE o_orderkey % 6 WHEN 0 THEN 'doi' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'pmcid' WHEN 3 THEN 'pmid' WHEN 4 THEN 'openalex' ELSE 'url' END AS kind, lower(regexp_extract(ref, '10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+')) AS doi FROM t
""")
def identifier_kinds(spark, sf_dir):
    k = F.col("o_orderkey")
    ref = (
        F.when(k % 6 == 0, F.concat(F.lit("https://doi.org/10.1000/"), F.col("o_custkey").cast("string")))
        .when(k % 6 == 1, F.concat(F.lit("arXiv:2101."), F.lpad(F.col("o_custkey").cast("string"), 5, "0")))
        .when(k % 6 == 2, F.concat(F.lit("PMC"), k.cast("string")))
        .when(k % 6 == 3, (k + 100000).cast("string"))
        .when(k % 6 == 4, F.concat(F.lit("W"), (k + 10000).cast("string")))
        .otherwise(F.concat(F.lit("http://x.example/"), k.cast("string")))
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ref.alias("ref"))
    return rows.select("o_orderkey", "ref", K.identifier_kind("ref").alias("kind"), K.doi("ref").alias("doi"))


@query("canonical_ids", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'doi:10.1/' || c_custkey WHEN c_custkey % 3 = 0 THEN 'pmid:' || c_custkey ELSE 's2:' || c_name END AS id FROM customer
""")
def canonical_ids(spark, sf_dir):
    k = F.col("c_custkey")
    doi = F.when(k % 2 == 0, F.concat(F.lit("10.1/"), k.cast("string"))).otherwise(F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", K.canonical_id(doi=doi, pmid=F.when(k % 3 == 0, k.cast("string")), s2=F.col("c_name")).alias("id"))
