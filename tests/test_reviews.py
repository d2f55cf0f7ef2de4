"""Filters, triage, evaluation, evidence and the replay source on small fixtures."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestar.operators import evaluation, events, evidence, filters
from lodestar.sources import papers
from lodestar.sources.replay import PaperReplies


def test_exclusion(spark):
    rules = filters.exclusion_rules({"exclude_articles": {"dois": "10.1/A", "titles": ["Deep: Learning"], "contains": ["spam"], "max_year": "2020"}})
    assert rules == {"ids": ["10.1/a"], "titles": ["deep: learning"], "refs": [], "substrings": ["spam"], "max_year": 2020}
    rows = spark.createDataFrame(
        [(1, ["https://doi.org/10.1/A"], [], 2000), (2, [], ["Deep learning!"], 2000), (3, ["x"], ["no SPAM here"], 2000), (4, ["x"], ["fine"], 2021), (5, ["x"], ["fine"], None), (6, ["10.1/ab"], [], 1)],
        "k int, ids array<string>, titles array<string>, year int",
    )
    out = filters.excluded(rules, F.col("ids"), F.col("titles"), F.array().cast("array<string>"), F.col("year"))
    # An identifier also excludes those that it begins.
    assert {r.k for r in rows.where(out).collect()} == {1, 2, 3, 4, 6}
    none = filters.exclusion_rules(None)
    assert rows.where(filters.excluded(none, F.col("ids"), F.col("titles"), F.col("ids"))).count() == 0


def test_weak_edges(spark):
    rows = spark.createDataFrame([("cooccurs_with", "", 0.22), ("cooccurs_with", "", 0.71), ("causes", "", 0.18), ("related_to", "", 0.1), ("co-occurs", "it leads to x", 0.1)], "p string, q string, s double")
    ask = lambda mode: [r.h for r in rows.select(filters.hidden([F.col("p"), F.col("q")], F.col("s"), mode).alias("h")).collect()]
    assert ask("hide_weak") == [True, False, False, False, False] and ask("exclude_all") == [True, True, False, False, True] and not any(ask("all"))


def test_triage(spark):
    rows = [
        ("causal inference", "causes", "credit limits", "A long enough snippet about the effect of limits.", 0.4, 2, 0.8),
        ("50%", "thanks", "data", "We thank the reviewers of this paper.", 0.0, 1, None),
        ("alpha", "mentions", "beta", None, None, 1, None),
        ("same", "uses", "Same ", "", 0.0, 1, 0.5),
    ]
    got = filters.triage(spark.createDataFrame(rows, "subject string, predicate string, object string, snippet string, importance double, papers int, quality double")).collect()
    assert [(r.verdict, r.triage_score) for r in got] == [("accept", 9.0), ("reject", -9.0), ("review", 0.0), ("review", 0.0)]
    assert got[1].reasons == ["subject is noise", "object is noise", "junk predicate", "evidence is no science"]


def test_rewriting_and_collapsing(spark):
    x = F.lit("see Figure 3")
    assert spark.range(1).select(filters.rewritten(x, [("Table", "T"), (r"Figure ([0-9])", "fig $1"), ("see", "-")]).alias("x")).first().x == "see fig 3"
    edges = spark.createDataFrame([("a", "b", "p", 0.0, 1, 2), ("b", "a", "q", 0.5, 1, 1), ("a", "a", "r", 9.0, 5, 0)], "source string, target string, predicate string, weight double, total_count int, edge_rank int")
    assert [tuple(r) for r in filters.collapsed(edges).collect()] == [("a", "b", 1.0, "q")]


def test_evaluation(spark):
    schema = "case string, subject string, predicate string, object string"
    p = spark.createDataFrame([("1", "a", "r", "b"), ("1", "A ", "r", "b"), ("1", "x", "r", "y"), ("3", "q", "r", "q")], schema)
    g = spark.createDataFrame([("1", "a", "r", "b"), ("2", "c", "r", "d")], schema)
    got = {r.case: r for r in evaluation.by_case(p, g, "case").collect()}
    assert got["1"].recall == 2.0 and abs(got["1"].precision - 2 / 3) < 1e-12 and got["2"].f1 == 0 and got["3"].n_gold == 0
    row = evaluation.corpus(p, g).first()
    assert (row.n_pred, row.n_gold, row.matched) == (3, 2, 1)
    a = spark.createDataFrame([("x", "accept", 1), ("x", "reject", 2), ("y", "accept", 1)], "k string, verdict string, pos int")
    b = spark.createDataFrame([("x", "reject", 1), ("z", "accept", 1)], "k string, verdict string, pos int")
    assert {r.k: r.status for r in evaluation.paired(a, b, "k", "pos").collect()} == {"x": "same", "y": "only_a", "z": "only_b"}
    assert evaluation.verdict_accuracy(b, a.where("pos = 2"), "k").first().accuracy == 1.0
    gates = evaluation.gates(spark.createDataFrame([(5, 0.2)], "n int, share double"), {"n": (">=", 6), "share": ("<=", 0.2)})
    assert [r.passed for r in gates.collect()] == [False, True]


def test_evidence(spark):
    assert spark.range(1).select(evidence.pages_of(F.lit("see p. 3 and pp. 5-7, pages 10-99")).alias("x")).first().x == [3, 5, 6, 7, 10, 11, 12, 13, 14, 15]
    sources = spark.createDataFrame([(1, "p", 4, ""), (2, "p", None, "Figure 7"), (3, "p", 90, ""), (4, "none", 1, "")], "source_id int, ref string, page int, locator string")
    assets = spark.createDataFrame([(10, "p", 5, "image", "figure 7"), (11, "p", 30, "table", "x"), (12, "p", None, "image", None)], "asset_id int, ref string, page int, kind string, label string")
    got = {(r.source_id, r.asset_id): r.how for r in evidence.assets_for(sources, assets, fallback=2).collect()}
    assert got == {(1, 10): "page", (2, 10): "label", (3, 10): "fallback", (3, 12): "fallback"}
    rows = spark.createDataFrame([(1, "a b c", [("x", "a b d"), ("y", "a b c"), ("z", "zzz"), ("w", "a b d")])], "key int, chosen string, candidates array<struct<kind:string,text:string>>")
    assert [r.kind for r in evidence.negatives(rows).orderBy("place").collect()] == ["x", "z"]


def test_versions_and_overrides(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    fixed = events.corrected(rows, spark.createDataFrame([(2, "c")], "id int, t string"), "id", ["t"])
    assert {tuple(r) for r in fixed.select("id", "t", "status", "version").collect()} == {(1, "a", "current", 1), (2, "b", "replaced", 1), (2, "c", "current", 2)}
    two = spark.createDataFrame([(1, "a", "b"), (2, "c", "d"), (3, "e", "f")], "id int, t string, u string")
    fixes = spark.createDataFrame([(1, None, "x", 1), (1, "y", None, 2), (2, None, None, 3), (9, "q", "q", 4)], "id int, t string, u string, seq int")
    found = events.corrected(two, fixes, "id", ["t", "u"], "seq")
    assert {tuple(r) for r in found.where("version = 2").select("id", "t", "u").collect()} == {(1, "y", "b")} and found.count() == 4
    edges = spark.createDataFrame([("s", 1.0), ("u", 2.0)], "k string, w double")
    votes = spark.createDataFrame([("s", 1.0), ("s", -0.25)], "k string, weight double")
    assert {r.k: r.expert_weight for r in events.apply_overrides(edges, votes, ["k"]).collect()} == {"s": 0.75, "u": 0.0}
    split = events.chronological_split(spark.range(10).select(F.lit("d").alias("day"), "id"), ["day", "id"])
    assert {r.id: r.split for r in split.collect()} == {k: "train" if k < 7 else "valid" if k < 8 else "test" for k in range(10)}


def test_replayed_replies(spark, tmp_path):
    (tmp_path / "crossref-1.jsonl").write_text(json.dumps({"title": ["A"], "DOI": "10.1/X"}) + "\nbroken\n")
    (tmp_path / "crossref-2.jsonl").write_text(json.dumps({"title": ["B"], "DOI": "10.1/Y"}) + "\n")
    (tmp_path / "arxiv-1.jsonl").write_text("{}\n")
    spark.dataSource.register(PaperReplies)
    rows = spark.read.format("papers").option("folder", str(tmp_path)).option("source", "crossref").load()
    assert {r.id for r in papers.from_crossref(rows.select("raw")).collect()} == {"doi:10.1/x", "doi:10.1/y"}
