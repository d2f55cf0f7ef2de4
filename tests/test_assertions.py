"""Rule-based triplets, resolution, rewards, validators, training records and sources on small fixtures."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestar.functions import keys
from lodestar.operators import hypotheses, resolution, reviews, rewards, training, triplets, validators, vectors
from lodestar.sources import bundles, papers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_entities_and_predicates(spark):
    clean = lambda x: one(spark, triplets.cleaned(F.lit(x)))
    assert clean("  The quick\n result of the [3] melt (see Fig. 2),;") == "quick melt"
    assert clean("the data") == "data" or clean("the data") == "the data"
    assert clean(" ".join(f"w{k}" for k in range(14))) == " ".join(f"w{k}" for k in range(10))
    good = lambda x: one(spark, triplets.informative(F.lit(x)))
    assert good("ion beam") and not good("ab") and not good("Table 3") and not good("123 456")
    name = lambda x: one(spark, triplets.canonical(F.lit(x)))
    assert [name(x) for x in ("Gives  rise to", "is followed by", "does not improve", "decreases")] == ["leads_to", "precedes", "does_not_improve", "reduces"]


def test_extracted_triplets(spark):
    rows = spark.createDataFrame(
        [
            (1, "Rising heat strongly causes grain growth. In 1999-04 the new coating was linked to wear; slow cooling prevents cracks.", 2010),
            (2, "Heat; coating. Nothing here.", 2011),
            (3, None, 2000),
            (4, "", None),
            (5, "Cooling before rolling reduces cracks, coating contradicts wear.", None),
            (6, " ".join(f"Alpha{k} causes beta{k}." for k in range(14)), 2000),
        ],
        "k long, t string, y int",
    )
    got = {}
    for r in triplets.extract(rows, "k", "t", "y").orderBy("k", "place").collect():
        got.setdefault(r.k, []).append(r)
    first = [(r.subject, r.predicate, r.object, r.confidence, r.polarity, r.time, r.time_source) for r in got[1]]
    assert ("Rising heat", "causes", "grain growth", 0.9, "supports", "2010", "paper_year_fallback") == first[0]
    assert ("slow cooling", "prevents", "cracks", 0.84, "supports", "1999-04", "extracted") in first
    assert first[-1][1:5] == ("associated_with", "wear", 0.56, "unknown")
    assert [(r.subject, r.predicate, r.object, r.confidence) for r in got[2]][0] == ("Heat", "associated_with", "coating", 0.46)
    assert 3 not in got and 4 not in got and len(got[6]) == 10
    assert {(r.predicate, r.polarity) for r in got[5]} >= {("contradicts", "contradicts")} and all(r.time is None for r in got[5])


def test_resolution(spark):
    found = lambda ref, title=None: one(spark, resolution.identity_keys(F.lit(ref).cast("string"), F.lit(title).cast("string")))
    assert found("https://doi.org/10.1000/AB.c", "A Title!") == ["doi:10.1000/ab.c", "https://doi.org/10.1000/AB.c", "title:a title"]
    assert found("arXiv:2101.00001v2") == ["arxiv:2101.00001v2"] and found(" 1234567 ") == ["pmid:1234567"] and found(None) == []
    assert one(spark, resolution.primary_key(F.lit("x y"), F.lit(""))) == "raw:x y"
    entries = spark.createDataFrame([(1, "10.1/a", "Deep melting of steel", 2001), (2, "?", "Cold rolling", 1990), (3, "?", "zzz", None)], "entry_id long, ref string, title string, year int")
    rows = [(1, 0, "p0", "Deep melting of steels", 2001, None, None, None, None, None), (1, 1, "p1", "other", 2001, "10.1000/a", None, None, "u", "x"), (2, 0, "p2", "Warm rolling", 1990, None, None, None, None, None), (3, 0, "p3", "qqqqqqq", 1990, None, None, None, None, None)]
    candidates = spark.createDataFrame(rows, "entry_id long, pos int, id string, title string, year int, doi string, arxiv string, openalex string, pdf_url string, abstract string")
    got = {r.entry_id: (r.id, r.score) for r in resolution.best_candidates(entries, candidates).collect()}
    assert got[1][0] == "p0" and got[1][1] > 4.8 and got[2][0] == "p2" and 3 not in got


def test_demos_roles_and_verdicts(spark):
    reviews_ = spark.createDataFrame([("d", "h1", "p", "2020", ["bad"], [], "fix it", True), ("d", "h2", "p", "", [], None, None, None)], "domain string, hypothesis_id string, path string, time_scope string, major_issues array<string>, minor_issues array<string>, suggested_revision string, accept boolean")
    got = {r.quality: r for r in reviews.hypothesis_demos(reviews_).collect()}
    assert got["gold"].hypothesis_text == "Time scope: 2020\nMajor: bad\nSuggested revision: fix it" and got["gold"].confidence == 6
    assert (got["silver"].verdict, got["silver"].summary, got["silver"].hypothesis_text) == ("needs_revision", "Needs revision", "")
    assert got["gold"].id == hashlib.sha1(b"hypothesis_test|d|h1|p").hexdigest()[:16]
    edges = spark.createDataFrame([("a", "causes", "b", 1.0, [("2001", None, "extracted"), ("2003-05", "2004", "extracted"), ("1990", None, "paper")], None), ("a", "is", "c", 2.0, [], [2005, 2001]), ("a", "is", "d", 3.0, None, None)], "subject string, predicate string, object string, score double, time_intervals array<struct<start:string,end:string,source:string>>, years array<int>")
    flat = {r.object: r for r in reviews.flattened(edges).collect()}
    assert (flat["b"].start_date, flat["b"].end_date, flat["b"].time_source, flat["b"].assertion_id) == ("2001", "2004", "triplet_extractor", "auto-00003")
    assert (flat["c"].start_date, flat["c"].valid_to, flat["c"].time_source) == ("2001", "2005", "metadata") and flat["d"].time_interval == "evidence:unknown..unknown|valid:unknown..unknown"


def test_rewards_of_odd_completions(spark):
    rows = [(None, "assertion_review_rl"), ("", "temporal_fix_rl"), ("[1]", "mm_review_rl"), ('{"a": {}}', "unheard_of"), ("{" * 50, "trajectory_reasoning_rl")]
    df = spark.createDataFrame(rows, "c string, f string")
    c, f = F.col("c"), F.col("f")
    empty = F.lit(None).cast("string")
    out = df.select(rewards.schema_validity(c, f).alias("a"), rewards.override_match(c, empty, f).alias("b"), rewards.evidence_presence(c, f).alias("d"), rewards.temporal_consistency(c, empty, f).alias("e"), rewards.graph_consistency(c, empty, f).alias("g")).collect()
    assert all(-1 <= x <= 1 for r in out for x in r)
    assert out[3].a == 0.5 and out[0].a == -1.0 and out[1].e == -1.0 and out[4].g == 0.0
    verdict = lambda x: one(spark, rewards.canonical_verdict(F.lit(x)))
    assert [verdict(x) for x in ("Accepted", "not correct", "unsupported", "needs_revision", "", "hm")] == ["accept", "reject", "reject", "revise", "unknown", "hm"]


def test_messages_get_as_many_images_as_there_are(spark):
    kind = "array<struct<role:string,content:array<struct<type:string,text:string>>>>"
    rows = [([("system", [("text", "s")]), ("user", [("image", None), ("text", "a")]), ("user", [("image", None)])], n) for n in (0, 1, 3)] + [([("system", [("text", "s")])], 1)]
    got = [[(m.role, [b.type for b in m.content]) for m in r.m] for r in spark.createDataFrame(rows, f"m {kind}, n int").select(training.aligned_messages(F.col("m"), F.col("n")).alias("m")).collect()]
    assert got[0] == [("system", ["text"]), ("user", ["text"])]
    assert got[1] == [("system", ["text"]), ("user", ["image", "text"])]
    assert got[2] == [("system", ["text"]), ("user", ["image", "image", "text"]), ("user", ["image"])]
    assert got[3] == [("user", ["image"]), ("system", ["text"])]


def test_validators_of_bare_documents(spark):
    docs = spark.createDataFrame([(None, 1, None, None)], "domain string, artifact_version int, steps array<struct<claim:string,conditions:map<string,string>,inference:string,next_question:string,sources:array<struct<type:string,source:string,snippet_or_summary:string>>>>, edges array<struct<from_step_id:int,to_step_id:int,predicate:string,directionality:string>>")
    assert docs.select(validators.trajectory_errors(docs).alias("e")).first().e == ["domain required", "steps[] must be a non-empty list"]
    step = ("c", {"k": "v"}, "i", "q", [("Figure", "s", "x")])
    edges = [(1, 2, "", "directed"), (1, 2, "leads_to", None), (2, 2, "", ""), (1, 9, "", ""), (None, 1, "", ""), (2, 1, "", "sideways")]
    full = spark.createDataFrame([("d", 3, [step, step], edges)], docs.schema)
    assert full.select(validators.trajectory_errors(full).alias("e")).first().e == ["edge 2: duplicate edge", "edge 3: self-loop is not allowed", "edge 4: out of range", "edge 5: from_step_id/to_step_id must be integers", "edge 6: invalid directionality"]


def test_candidate_snippets(spark):
    cut = lambda t, a, b: one(spark, hypotheses.snippet(F.lit(t), F.lit(a), F.lit(b)))
    assert cut("One. The Alpha meets beta here. End", "alpha", "beta") == "The Alpha meets beta here"
    assert cut("alpha " + "x" * 400, "alpha", "beta").startswith("alpha xxx") and len(cut("q" * 400, "alpha", "beta")) == 220


def test_hashes(spark):
    assert one(spark, keys.uuid5_url(F.lit("doc:1 é"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "doc:1 é"))
    same = str(uuid.uuid4())
    assert one(spark, keys.uuid5_url(F.lit(same))) == same
    rows = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None)], "k int, t array<string>")
    got = {r.k: list(r.embedding) for r in vectors.blake_vectors(rows, "k", "t", dim=16).collect()}
    want = [0.0] * 16
    for word in ("a", "b", "a"):
        n = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        want[n % 16] += -1.0 if n & 1 else 1.0
    size = sum(x * x for x in want) ** 0.5
    assert got[1] == pytest.approx([x / size for x in want]) and got[2] == got[3] == [0.0] * 16
    slots = {(r.k, r.slot): r.value for r in vectors.hashed_counts(rows, "k", "t", dim=16).collect()}
    assert sum(v * v for v in slots.values()) == pytest.approx(1.0) and {k for k, _ in slots} == {1}


def test_feeds_and_lookups(spark):
    feed = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>q</title>
    <entry><id>http://arxiv.org/abs/2101.00001v1</id><title>A  b
 c</title><summary>S &amp; t</summary><published>2021-01-02T00:00:00Z</published><author><name>Ann One</name></author><author><name>Bo Two</name></author><arxiv:doi>10.1/X</arxiv:doi><link title="pdf" href="http://arxiv.org/pdf/2101.00001v1"/></entry></feed>"""
    row = papers.from_arxiv(papers.atom_entries(spark.createDataFrame([(feed,), ("",)], "xml string"))).first()
    assert (row.id, row.title, row.abstract, row.year, row.authors, row.pdf_url) == ("doi:10.1/x", "A b c", "S & t", 2021, ["Ann One", "Bo Two"], "http://arxiv.org/pdf/2101.00001v1")
    ids = spark.createDataFrame([(0, "2"), (1, "1"), (2, "3")], "pos int, pmid string")
    summaries = spark.createDataFrame([("1", "T1", "2001 Jan", None, ["A"]), ("2", "T2", "x", "10.1/B", None)], "pmid string, title string, pubdate string, doi string, authors array<string>")
    joined = papers.pubmed_joined(ids, summaries, spark.createDataFrame([("1", "abs")], "pmid string, abstract string")).orderBy("pos")
    got = papers.from_pubmed(joined.select("raw")).collect()
    assert [(r.id, r.title, r.year, r.abstract, r.authors) for r in got] == [("doi:10.1/b", "T2", None, None, None), ("pmid:1", "T1", 2001, "abs", ["A"]), ("pmid:3", None, None, None, None)]
    rows = papers.from_pubmed(joined.select("raw"))
    assert papers.lookup(rows, doi="10.1/B").first().title == "T2" and papers.best_title_match(rows, "the t1").first().pmid == "1"


def test_pdf_candidates_of_all_kinds(spark):
    rows = spark.createDataFrame(
        [("a", None, "2101.1", "https://aclanthology.org/P1/", "10.1371/journal.pone.01", "PMC5", "7", ["10.1000/h", "http://h/x.pdf"]), ("w", "http://p", None, "https://en.wikipedia.org/wiki/X", None, None, None, None)],
        "id string, pdf_url string, arxiv string, url string, doi string, pmcid string, pmid string, hints array<string>",
    )
    got = {}
    for r in papers.pdf_candidates(rows).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.url)
    assert got["w"] == ["http://p"]
    assert got["a"] == [
        "https://arxiv.org/pdf/2101.1.pdf", "https://aclanthology.org/P1.pdf", "https://aclanthology.org/P1/", "https://doi.org/10.1371/journal.pone.01",
        "https://journals.plos.org/plosone/article?id=10.1371%2Fjournal.pone.01", "https://journals.plos.org/plosone/article/file?id=10.1371%2Fjournal.pone.01&type=printable",
        "https://pmc.ncbi.nlm.nih.gov/articles/PMC5/", "https://pmc.ncbi.nlm.nih.gov/articles/PMC5/pdf/", "https://pubmed.ncbi.nlm.nih.gov/7/", "https://doi.org/10.1000/h", "http://h/x.pdf",
    ]
    page = """<meta name="citation_pdf_url" content="/a.pdf"><a href="b/c.pdf?x=1">t</a><a class=k href='//o.org/d'><b>Download</b> it</a><a href="e">no</a>"""
    assert one(spark, papers.pdf_links(F.lit(page), F.lit("https://s.org/x/y?q"))) == ["https://s.org/a.pdf", "https://s.org/x/b/c.pdf?x=1", "https://o.org/d"]


def test_bundles_archives_and_documents(spark, tmp_path):
    files = spark.createDataFrame([("/r/a/edge_reviews.json",), ("/r/a/x.yaml",), ("/r/b/t.yaml",), ("/r/b/n.txt",), ("/r/z.zip",), ("/r/a/in/edge_reviews.json",)], "path string")
    assert {tuple(r) for r in bundles.review_inputs(files).collect()} == {("/r/a", "bundle"), ("/r/b/t.yaml", "trajectory"), ("/r/z.zip", "bundle")}
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("d/x.json", "{}")
    (tmp_path / "a.zip").write_bytes(held.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no archive")
    (tmp_path / "c.yaml").write_text("k: [1, 2]")
    (tmp_path / "d.json").write_text('{"k": 1}')
    table = spark.read.format("binaryFile").load(f"file://{tmp_path}")
    assert [(r.member, bytes(r.content)) for r in bundles.archive_members(table).collect()] == [("d/x.json", b"{}")]
    read = {r.path[-6:]: r.json for r in bundles.yaml_documents(table.where("path LIKE '%.yaml' OR path LIKE '%.json'")).collect()}
    assert json.loads(read["d.json"]) == {"k": 1} and read["c.yaml"] in (None, '{"k": [1, 2]}')
    pages = spark.createDataFrame([("p", 1, "x" * 500), ("p", 2, "y" * 500), ("p", 3, "z" * 500), ("p", 4, ""), ("q", 1, "short")], "path string, page int, text string")
    assert {r.path: r.native for r in bundles.text_native(pages).collect()} == {"p": True, "q": False}
    trees = sinks.time_graph(spark.createDataFrame([(1, "s", "p", "o", "2020", None, "year"), (2, "s", "p", "q", "2020", "2020", "year")], "event_id int, subject string, predicate string, object string, start string, end string, granularity string"))
    assert trees["Time"].count() == 1 and trees["AT_TIME"].count() == 2
