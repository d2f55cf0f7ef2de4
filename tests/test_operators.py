"""Operators on small fixtures with known results."""

from __future__ import annotations

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import dates, keys, text
from lodestar.operators import communities, datasets, extraction, graph, links, matching, order, searches, vectors
from lodestar.sources import bundles, papers, sinks
from lodestar.streaming import events as streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.norm(lit("  A\t b\n"))) == "a b"
    assert one(spark, text.title_key(lit("Deep-Learning: a Survey!"))) == "deep learning a survey"
    assert one(spark, text.slug(lit("--Ab c_9é"))) == "ab-c-9"
    assert one(spark, text.truncate(lit("hello world"), 7)) == "hello…"
    assert one(spark, text.chunks(lit(""))) == [] and len(one(spark, text.chunks(lit("x" * 2401)))) == 3
    assert one(spark, text.sentences(lit("Short. This one is long enough to keep. No."))) == ["this one is long enough to keep"]
    assert one(spark, text.sentences(lit("Tiny."))) == ["tiny."]
    assert one(spark, text.phrases(lit("the quick brown fox of a red hen"))) == [["quick", "brown", "fox"], ["red", "hen"]]
    assert [one(spark, text.verdict(lit(x))) for x in ("Correct", "not correct", "needs work", "?")] == ["accept", "reject", "revise", "unknown"]
    assert one(spark, text.jaccard(F.array(lit(1), lit(2)), F.array(lit(2), lit(3)))) == 1 / 3


def test_keys_and_dates(spark):
    assert one(spark, keys.url_canonical(F.lit("HTTP://WWW.Ex.org/A/b/?q=1#x"))) == "http://www.ex.org/A/b"
    assert one(spark, keys.url_variants(F.lit("https://www.ex.org/p.pdf"))) == ["https://www.ex.org/p.pdf", "https://ex.org/p.pdf", "https://ex.org/p", "ex.org/p.pdf"]
    assert [one(spark, keys.identifier_kind(F.lit(x))) for x in ("doi:10.1000/x", "2101.00001v2", "PMC12", "123456", "W12345", "https://x", "?")] == ["doi", "arxiv", "pmcid", "pmid", "openalex", "url", "unknown"]
    assert one(spark, keys.canonical_id(doi=F.lit(" "), pmid=F.lit("5"))) == "pmid:5"
    assert [one(spark, dates.time_number(F.lit(x))) for x in ("2020", "2020-03", "2020-03-04", "?")] == [2020, 2020 * 12 + 3, 2020 * 372 + 3 * 31 + 4, 0]
    assert [one(spark, dates.safe_year(F.lit(x), 7)) for x in ("1999-01", "1700", "ab")] == [1999, 7, 7]
    assert str(one(spark, dates.first_day(F.lit("2020-05")))) == "2020-05-01"
    assert abs(one(spark, dates.decay(F.lit(2), 2.0)) - 0.5) < 1e-12


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, weight long")


def test_graph_of_two_cliques(spark):
    pairs = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5), (10, 11)]
    g = edges(spark, pairs)
    assert {r.node: r.component for r in graph.components(g).collect()} == {k: 0 for k in range(6)} | {10: 10, 11: 10}
    assert {r.node: r.core for r in graph.core_numbers(g).collect()} == {k: 2 for k in range(6)} | {10: 1, 11: 1}
    tri = {r.node: (r.triangles, r.clustering) for r in graph.triangles(g).collect()}
    assert tri[0] == (1, 1.0) and tri[2][0] == 1 and abs(tri[2][1] - 1 / 3) < 1e-12 and tri[10] == (0, 0.0)
    nodes = graph.degrees(g).select("node")
    between = {(r.u, r.v): r.dependency / 2 for r in graph.dependencies(g, nodes).collect()}
    assert between[2, 3] == 9.0 and between[2, 2] == 6.0 and between[0, 1] == 1.0
    share = {(r.u, r.v): r.betweenness for r in graph.betweenness(g, nodes).collect()}
    assert abs(share[2, 3] - 18 / 56) < 1e-12 and abs(share[2, 2] - 12 / 42) < 1e-12
    near = {r.node: r.closeness for r in graph.closeness(g, nodes).collect()}
    assert abs(near[2] - 25 / (7 * 7)) < 1e-12 and abs(near[10] - 1 / 7) < 1e-12
    labels = {r.node: r.community for r in graph.label_propagation(g).collect()}
    assert labels[10] == labels[11] or {labels[10], labels[11]} == {10, 11}
    reach = {(r.node): r.distance for r in graph.distances(g, spark.createDataFrame([(0,)], "node long"), 3).collect()}
    assert reach == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 3}
    total = sum(r["rank"] for r in graph.pagerank(g, rounds=30).collect())
    assert abs(total - 1) < 1e-9


def test_core_numbers_of_a_star_and_nothing(spark):
    assert {r.node: r.core for r in graph.core_numbers(edges(spark, [(0, k) for k in range(1, 6)])).collect()} == {k: 1 for k in range(6)}
    assert graph.core_numbers(edges(spark, [])).count() == 0
    assert graph.components(edges(spark, [])).count() == 0


def test_link_scores(spark):
    g = edges(spark, [(0, 1), (1, 2), (0, 3), (2, 3), (3, 4)])
    got = {(r.u, r.v): r for r in links.neighbour_scores(g, spark.createDataFrame([(0,)], "node long")).collect()}
    assert set(got) == {(0, 2), (0, 4)} and got[0, 2].common == 2 and got[0, 2].jaccard == 1.0
    ranked = spark.createDataFrame([(1, 2, 1), (3, 4, 2)], "u long, v long, rank int")
    row = links.hits_and_mrr(ranked, spark.createDataFrame([(2, 1), (4, 3), (9, 8)], "u long, v long")).first()
    assert abs(row.hits_at_1 - 1 / 3) < 1e-12 and abs(row.mrr - 0.5) < 1e-12


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.vec_id, r["rank"]) for r in vectors.nearest(rows, rows.where("vec_id = 1"), 2, block=1).orderBy("rank").collect()]
    assert got == [(2, 1), (3, 2)]
    assert one(spark, vectors.blend(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0)))) == [1.0, 0.7]
    assert vectors.nearest(rows, rows.limit(0), 2).count() == 0


def test_matching(spark):
    a = spark.createDataFrame([(1, "x", 5.0, None), (2, "y", 1.0, "q")], "k long, name string, n double, extra string")
    b = spark.createDataFrame([(1, "longer", 3.0, "e")], "k long, name string, n double, extra string")
    got = {r.k: r for r in matching.merged([a, b], "k", ["extra"], longest=["name"], largest=["n"]).collect()}
    assert (got[1].name, got[1].n, got[1].extra, got[1].n_sources) == ("longer", 5.0, "e", 2)
    words = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["a", "b", "c", "d", "e"]), (3, ["x", "y"]), (4, [])], "k long, t array<string>")
    pairs = [(r.a, r.b) for r in matching.token_pairs(words, "k", "t", 0.8).collect()]
    assert pairs == [(1, 2)]
    assert spark.createDataFrame([("abcd", "bcde"), (None, None)], "a string, b string").select(matching.sequence_ratio("a", "b").alias("r")).collect()[0].r == 0.75


def test_extraction(spark):
    assert extraction.repaired('```json\n{"a": [1, 2], "b": "x\\q"}\n``` tail') == '{"a": [1, 2], "b": "x\\\\q"}'
    assert extraction.repaired("{'a': True}") == '{"a": true}' and extraction.repaired("none") is None
    rows = spark.createDataFrame([(float(k), float(k > 5)) for k in range(12)], "x double, y double")
    bias, (weight,) = extraction.train_scorer(rows, ["x"], "y", epochs=2000, rate=0.1)
    assert weight > 0 and bias < 0


def test_datasets(spark):
    turns = spark.createDataFrame([(1, t, r, x) for t, (r, x) in enumerate([("user", "q one"), ("assistant", "a b c"), ("user", "q two"), ("assistant", "a b d")])], "conv_id long, turn long, role string, text string")
    pair = datasets.preference_pairs(turns).first()
    assert pair.chosen == "a b d" and pair.rejected == "a b c" and abs(pair.hardness - (0.7 * 0.5 + 0.3)) < 1e-12
    whole = [r.text for r in datasets.within_budget(turns, "conv_id", "turn", "text", 12).orderBy("turn").collect()]
    assert whole == ["q one", "a b c"]  # the third does not fit and ends the prefix
    strata = spark.createDataFrame([(f"{s}{k}", s) for s, n in (("a", 10), ("b", 3), ("c", 1), ("d", 2)) for k in range(n)], "id string, s string")
    evals = {r.s: r.n for r in datasets.stratified_split(strata, "s", "id", 0.2, "1").where("split = 'eval'").groupBy("s").agg(F.count("*").alias("n")).collect()}
    assert evals == {"a": 2, "b": 1, "d": 1}
    alone = spark.createDataFrame([("g", 1), ("g", 2)], "s string, i int")
    assert datasets.group_split(alone, "s", 0.5, "1").first().split == "train"
    z = {r.v: r.z for r in datasets.robust_scores(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 100.0), ("b", 0.5)], "g string, v double"), "g", "v").collect()}
    assert z[2.0] == 0 and z[100.0] > 0.9 and abs(z[0.5] - 0.46211715726) < 1e-9


def test_sources_and_sinks(spark, tmp_path):
    root = tmp_path / "papers"
    for name, body in (("p1", "first chunk"), ("p2", "x" * 50_000)):
        (root / name / "mm").mkdir(parents=True)
        (root / name / "meta.json").write_text(json.dumps({"id": name, "title": f"T {name}", "year": 2020, "abstract": "abs"}, indent=1))
        (root / name / "chunks.jsonl").write_text(json.dumps({"chunk_id": f"{name}:0", "paper_id": name, "text": body}) + "\nnot json\n" + json.dumps({"chunk_id": f"{name}:1", "text": "second"}) + "\n")
        (root / name / "mm/pages.jsonl").write_text(json.dumps({"paper_id": name, "page": 1, "text": "t", "tables_md": "a|b"}) + "\n")
    chunks = papers.processed_chunks(spark, f"file://{root}")
    records = {r.paper_id: r.text for r in papers.text_records(papers.processed_meta(spark, f"file://{root}"), chunks).collect()}
    assert records["p1"] == "first chunk\nsecond" and len(records["p2"]) == papers.LETTERS
    assert papers.chunk_registry(spark, f"file://{root}").count() == 2 * 2 + 1 * 2 + 2 - 1
    raw = spark.createDataFrame([(json.dumps({"title": "A", "doi": "https://doi.org/10.1/AB", "publication_year": 2021, "abstract_inverted_index": {"hello": [0, 2], "world": [1]}}),)], "raw string")
    work = papers.from_openalex(raw).first()
    assert (work.id, work.abstract, work.year) == ("doi:10.1/ab", "hello world hello", 2021)
    item = spark.createDataFrame([(json.dumps({"title": ["A b"], "DOI": "10.1/ab", "issued": {"date-parts": [[2019, 3]]}, "is-referenced-by-count": 4}),)], "raw string")
    both = papers.federated([papers.from_crossref(item), papers.from_openalex(raw)]).first()
    assert (both.sources, both.year, both.citation_count, both.abstract) == ("crossref,openalex", 2019, 4, "hello world hello")
    assert one(spark, sinks.safe_name(F.lit("a/b c"))) == "a_b_c" and len(one(spark, sinks.safe_name(F.lit("x" * 300)))) == 160
    assert sinks.flat(spark.createDataFrame([([1, 2],)], "a array<int>")).first().a == "[1,2]"
    assert one(spark, bundles.tei_text(F.lit("<TEI><title>T</title><text><p>a  b</p></text></TEI>"))) == "T a b"


def test_trajectories(spark, tmp_path):
    step = lambda k: {"step_id": k, "claim": f"c{k}", "sources": [{"source": "s"}]}
    docs = [{"submission_id": "a", "steps": [step(1), step(2), step(3)], "edges": []}, {"submission_id": "b", "steps": [step(1), step(2)], "edges": [{"from_step_id": 1, "to_step_id": 2, "predicate": "causes", "directionality": "bidirectional"}, {"from_step": 2, "to_step": 1, "label": "x"}]}]
    for d in docs:
        (tmp_path / f"{d['submission_id']}.json").write_text(json.dumps(d))
    read = bundles.trajectories(spark, f"file://{tmp_path}/*.json")
    got = {tuple(r) for r in bundles.trajectory_edges(read).collect()}
    assert got == {("a", 1, 2, "leads_to"), ("a", 2, 3, "leads_to"), ("b", 1, 2, "causes"), ("b", 2, 1, "causes")}
    assert ("b", 2, 1, "x") in {tuple(r) for r in bundles.trajectory_edges(read, both_spellings=True).collect()}
    assert bundles.trajectory_sources(read).count() == 5


def test_stream_upserts(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(k, 1, f"v{k}"), (k + 10, 2 + k, "w")], "event_id long, user_id long, value string").coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    schema = "event_id long, user_id long, value string"
    rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    rows.writeStream.foreachBatch(streams.upsert_into(out, ["user_id"], "event_id")).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    last = streams.state(spark, out)
    assert {(r.user_id, r.event_id) for r in last.collect()} == {(1, 1), (2, 10), (3, 11)}


def test_communities(spark):
    g = edges(spark, [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5), (10, 11)])
    assert {r.node: r.community for r in communities.greedy_modularity(g).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 10: 10, 11: 10}
    assert [tuple(r) for r in communities.largest(communities.greedy_modularity(g), 2).collect()] == [(1, 0, 3), (2, 3, 3)]
    assert {r.members for r in communities.cliques(g).collect()} == {"0,1,2", "3,4,5"}
    assert {r.members for r in communities.cliques(g, least=2).collect()} == {"0,1,2", "3,4,5", "2,3", "10,11"}
    assert communities.cliques(edges(spark, [])).count() == communities.greedy_modularity(edges(spark, [])).count() == 0


def test_cliques_match_all_subsets(spark):
    rng = random.Random(3)
    pairs = {tuple(sorted(rng.sample(range(14), 2))) for _ in range(45)}
    near = {v: {a + b - v for a, b in pairs if v in (a, b)} for v in range(14)}
    full = [set(c) for n in range(2, 8) for c in itertools.combinations(range(14), n) if all(b in near[a] for a, b in itertools.combinations(c, 2))]
    want = {",".join(map(str, sorted(c))) for c in full if not any(c < d for d in full)}
    assert {r.members for r in communities.cliques(edges(spark, pairs), least=2).collect()} == want


def test_spectral_scores_match_numpy(spark):
    pairs = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5), (5, 6)]
    got = {(r.u, r.v): r.score for r in communities.spectral_scores(edges(spark, pairs), vectors=3, k=5).collect()}
    a = np.zeros((7, 7))
    for x, y in pairs:
        a[x, y] = a[y, x] = 1
    values, basis = np.linalg.eigh(a)
    v = basis[:, np.argsort(values)[::-1][:3]]
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = sorted(((float(v[x] @ v[y]), x, y) for x in range(7) for y in range(x + 1, 7) if not a[x, y]), reverse=True)[:5]
    assert len(got) == 5 and all(abs(got[x, y] - s) < 1e-6 for s, x, y in want)


def test_core_numbers_match_peeling(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(130)}
    near = {v: {a + b - v for a, b in pairs if v in (a, b)} for v in range(40)}
    near = {v: n for v, n in near.items() if n}
    want, left, k = {}, {v: set(n) for v, n in near.items()}, 0
    while left:
        low = [v for v in left if len(left[v]) <= k]
        if not low:
            k += 1
        for v in low:
            want[v] = k
            for u in left.pop(v):
                left.get(u, set()).discard(v)
    assert {r.node: r.core for r in graph.core_numbers(edges(spark, pairs)).collect()} == want


def test_directed_rank_with_open_ends(spark):
    g = edges(spark, [(0, 1), (0, 2), (1, 2)])
    got = {r.node: r["rank"] for r in graph.pagerank(g, directed=True, tolerance=1e-12, rounds=200).collect()}
    rank = {v: 1 / 3 for v in range(3)}
    for _ in range(500):
        given = {0: 0.0, 1: rank[0] / 2, 2: rank[0] / 2 + rank[1]}
        rank = {v: 0.15 / 3 + 0.85 * (given[v] + rank[2] / 3) for v in range(3)}
    assert all(abs(got[v] - rank[v]) < 1e-6 for v in rank) and abs(sum(got.values()) - 1) < 1e-9
    degree = {r.node: (r.in_degree, r.out_degree, r.in_centrality) for r in graph.directed_centrality(g).collect()}
    assert degree == {0: (0, 2, 0.0), 1: (1, 1, 0.5), 2: (2, 0, 1.0)}
    row = graph.structure(spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 5), (7, 8)], "src long, dst long")).first()
    assert (row.n_nodes, row.n_edges, row.self_loops, row.n_components, row.largest_component) == (6, 4, 1, 3, 3) and abs(row.average_clustering - 0.5) < 1e-12


def test_searches_from_nothing_and_weighted(spark):
    g = spark.createDataFrame([(0, 1, 5.0), (1, 2, 1.0), (0, 2, 9.0), (2, 3, 1.0)], "src long, dst long, weight double")
    source = spark.createDataFrame([(0,), (99,)], "node long")
    assert {r.node: r.distance for r in graph.weighted_distances(g, source, 3).where("source = 0").collect()} == {0: 0.0, 1: 5.0, 2: 6.0, 3: 7.0}
    assert graph.dependencies(g, source.where("node = 99")).count() == 0 and graph.distances(g, source.where("node = 99"), 2).count() == 0
    found = graph.paths(graph.both_ways(g), source, spark.createDataFrame([(3,)], "node long"), hops=3, most=2)
    assert [tuple(r.path) for r in found.orderBy("place").collect()] == [(0, 2, 3), (0, 1, 2, 3)]


def test_token_pairs_of_long_rows_match_all_pairs(spark):
    rows = []
    for size in (*range(3, 31), 40):
        shared = [f"s{size}x{i}" for i in range(size - 1)]
        # The token of its own is the rarest of each row, the shared ones are in both.
        rows += [(10 * size, [*shared, f"a{size}"]), (10 * size + 1, [*shared, f"b{size}"]), (10 * size + 2, [*shared, f"c{size}", f"d{size}", f"e{size}"])]
    for threshold in (0.8, 0.85, 0.95):
        want = set()
        for i, (a, x) in enumerate(rows):
            for b, y in rows[i + 1 :]:
                both = len(set(x) & set(y))
                if max(both / len(set(x) | set(y)), 0.9 * both / min(len(x), len(y))) >= threshold:
                    want.add((a, b))
        got = matching.token_pairs(spark.createDataFrame(rows, "k long, t array<string>"), "k", "t", threshold).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_names_merge_in_order(spark):
    frequency = {"a b c d e f": 1, "a b c d e": 5, "a b c d e f g": 2, "x y": 1, "x y z": 1}
    pairs = [("a b c d e", "a b c d e f"), ("a b c d e f", "a b c d e f g"), ("x y", "x y z")]
    names = spark.createDataFrame(list(frequency.items()), "name string, n long")
    got = {r.name: r.canonical for r in matching.fuzzy_names(spark.createDataFrame(pairs, "a string, b string"), names).collect()}
    # The first takes in the second, which is then taken and takes in nothing itself.
    assert got == {"a b c d e f": "a b c d e", "x y z": "x y"}
    assert matching.merged_in_order([("a", "b"), ("a", "c")], {"a": 1, "b": 2, "c": 3}) == {"a": "c"}
    links = spark.createDataFrame([("x y", "q", 1), ("x y z", "q", 2), ("x y", "x y z", 4)], "source string, target string, n long")
    renamed = matching.renamed_edges(links, spark.createDataFrame(list(got.items()), "name string, canonical string"), [], ["n"])
    assert [tuple(r) for r in renamed.collect()] == [("x y", "q", 3)]


def test_positions_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("v"))
    for parts in (1, 7):
        got = {r.k: (r["__place"], r["__before"]) for r in order.running(rows.repartition(parts), ["k"], "v").collect()}
        value = {r.k: r.v for r in rows.collect()}
        before = 0
        for place, k in enumerate(range(1000), 1):
            assert got[k] == (place, before)
            before += value[k]


def test_importance_matches_plain_loops(spark):
    """Every metric of a small directed graph by its definition, over all nodes as sources."""
    links = [("a", "b", 3, 2, 1, [2001, 2003]), ("b", "c", 1, 1, 4, [2002]), ("c", "a", 2, 1, 0, []), ("c", "d", 1, 1, 1, [2000, 2001, 2004]), ("d", "e", 5, 3, 2, [2001]), ("f", "d", 1, 1, 1, [1999])]
    nodes = sorted({x for s, d, *_ in links for x in (s, d)})
    community = {"a": 1, "b": 1, "c": 1, "d": 2, "e": 2}
    n = len(nodes)
    near = {v: {d for s, d, *_ in links if s == v} | {s for s, d, *_ in links if d == v} for v in nodes}
    through = dict.fromkeys([*nodes, *(frozenset(x[:2]) for x in links)], 0.0)
    for s in nodes:
        for t in nodes:
            paths = [[s]]
            while paths and s != t and all(p[-1] != t for p in paths):
                paths = [[*p, v] for p in paths for v in near[p[-1]] if v not in p]
            paths = [p for p in paths if p[-1] == t and s != t]
            for p in paths:
                for v in p[1:-1]:
                    through[v] += 1 / len(paths)
                for x in itertools.pairwise(p):
                    through[frozenset(x)] += 1 / len(paths)
    rank = dict.fromkeys(nodes, 1 / n)
    outs = {v: [d for s, d, *_ in links if s == v] for v in nodes}
    for _ in range(300):
        lost = sum(rank[v] for v in nodes if not outs[v])
        rank = {v: 0.15 / n + 0.85 * (sum(rank[u] / len(outs[u]) for u in nodes if v in outs[u]) + lost / n) for v in nodes}
    core = {"a": 2, "b": 2, "c": 2, "d": 1, "e": 1, "f": 1}
    rows = {}
    for s, d, total, papers_, evidence_, years in links:
        span = max(years) - min(years) + 1 if years else 0
        rows[s, d] = [
            through[frozenset((s, d))] / (n * (n - 1)), (rank[s] + rank[d]) / 2, (through[s] + through[d]) / 2 / ((n - 1) * (n - 2)), (core[s] + core[d]) / 2,
            (len(outs[s]) + sum(d in outs[u] for u in nodes)) / 2 / (n - 1), total, papers_, evidence_, len(years), span, len(years) / span if span else 0,
        ]
    most = [max(r[k] for r in rows.values()) for k in range(11)]
    want = {}
    for (s, d), r in rows.items():
        x = [v / m if m else 0 for v, m in zip(r, most, strict=True)]
        cross = s in community and d in community and community[s] != community[d]
        want[s, d] = 0.28 * x[0] + 0.18 * x[1] + 0.14 * x[2] + 0.12 * x[3] + 0.10 * x[4] + 0.10 * sum(x[5:8]) / 3 + 0.05 * sum(x[8:]) / 3 + 0.03 * cross
    df = spark.createDataFrame(links, "src string, dst string, total_count long, papers_count long, evidence_count long, years array<int>")
    labels = spark.createDataFrame(list(community.items()), "node string, community long")
    got = {(r.src, r.dst): r.importance for r in graph.importance(df, spark.createDataFrame([(v,) for v in nodes], "node string"), labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-4 for k in want), (got, want)


@pytest.fixture
def held(monkeypatch):
    """Components of at most 13 links in arrays, others by joins; and a few links or sources a piece."""
    for name, value in {"HELD": 13, "SMALL": 3, "SOURCES": (2, 3), "STATE": 20, "PIECE": 4, "FOREST": 5, "ROWS": 7}.items():
        monkeypatch.setattr(searches, name, value)


def _odd_graph(spark):
    """Components of 13 and of 14 links, a pair and a path; names are strings, so order is not that of numbers."""
    pairs = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 6), (6, 7), (7, 8), (5, 8), (8, 9), (9, 10), (10, 11), (2, 11), *itertools.combinations(range(20, 25), 2), (24, 25), (25, 26), (26, 27), (27, 20), (30, 31), (40, 41), (41, 42)]
    pairs = [(min(str(a), str(b)), max(str(a), str(b)), 1.0 + (a * b) % 4) for a, b in pairs]
    near = {}
    for a, b, w in pairs:
        near.setdefault(a, {})[b] = w
        near.setdefault(b, {})[a] = w
    return spark.createDataFrame(pairs, "src string, dst string, weight double").coalesce(1), near, ["1", "5", "10", "20", "26", "31", "41"]


def _hops(near, s):
    far, front = {s: 0}, [s]
    while front:
        front = [v for v in dict.fromkeys(v for u in front for v in near[u]) if v not in far and not far.update({v: far[u] + 1 for u in front if v in near[u]})]
    return far


def test_hop_distances_in_arrays_and_joins(spark, held):
    g, near, sources = _odd_graph(spark)
    starts = spark.createDataFrame([(s,) for s in [*sources, sources[0], "99"]], "node string")
    want = sorted((s, v, d) for s in sources for v, d in _hops(near, s).items() if d <= 3)
    assert sorted(tuple(r) for r in graph.distances(g, starts, 3).collect()) == want
    null = graph.distances(g.union(spark.createDataFrame([("50", None, 1.0)], g.schema)), spark.createDataFrame([("50",), ("31",)], "node string"), 3)
    assert sorted((tuple(r) for r in null.collect()), key=str) == [("31", "30", 1), ("31", "31", 0), ("50", "50", 0), ("50", None, 1)]


def test_a_component_is_searched_without_a_row_per_source_and_node(spark, monkeypatch):
    """Joins of levels made a row per source and node in every round, which a graph of some 600,000 links did not bear."""
    monkeypatch.setattr(graph, "levels", None)
    g, near, sources = _odd_graph(spark)
    starts = spark.createDataFrame([(s,) for s in sources], "node string")
    assert graph.distances(g, starts, 2).count() == sum(d <= 2 for s in sources for d in _hops(near, s).values())


def test_weighted_distances_in_arrays_and_joins(spark, held):
    g, near, sources = _odd_graph(spark)
    want = set()
    for s in sources:
        best = {s: 0.0}
        for _ in range(3):
            step = dict(best)
            for u, d in best.items():
                for v, w in near[u].items():
                    step[v] = min(step.get(v, np.inf), d + w)
            best = step
        want |= {(s, v, d) for v, d in best.items()}
    starts = spark.createDataFrame([(s,) for s in [*sources, "99"]], "node string")
    got = graph.weighted_distances(g, starts, 3).collect()
    assert {tuple(r) for r in got} == want | {("99", "99", 0.0)} and len(got) == len(want) + 1


def test_closeness_in_arrays_and_joins(spark, held):
    g, near, sources = _odd_graph(spark)
    got = {r.node: r.closeness for r in graph.closeness(g, spark.createDataFrame([(s,) for s in sources], "node string")).collect()}
    for s in sources:
        far = _hops(near, s)
        assert abs(got.pop(s) - (len(far) - 1) ** 2 / ((len(near) - 1) * sum(far.values()))) < 1e-12
    assert not got


def test_dependencies_in_arrays_and_joins(spark, held):
    g, near, sources = _odd_graph(spark)
    want = {}
    for s in sources:
        far = _hops(near, s)
        paths, share = {s: 1.0}, dict.fromkeys(far, 0.0)
        order_ = sorted(far, key=far.get)
        for v in order_[1:]:
            paths[v] = sum(paths[u] for u in near[v] if far[u] == far[v] - 1)
        for v in reversed(order_[1:]):
            for u in near[v]:
                if far[u] == far[v] - 1:
                    part = paths[u] / paths[v] * (1 + share[v])
                    share[u] += part
                    pair = min(u, v), max(u, v)
                    want[pair] = want.get(pair, 0.0) + part
            want[v, v] = want.get((v, v), 0.0) + share[v]
    got = {(r.u, r.v): r.dependency for r in graph.dependencies(g, spark.createDataFrame([(s,) for s in sources], "node string")).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def _plain_communities(pairs):
    """The rounds of greedy_modularity by their definition."""
    total = sum(pairs.values())
    label = {v: v for p in pairs for v in p}
    while True:
        strength, between = {}, {}
        for (u, v), w in pairs.items():
            for x in (u, v):
                strength[label[x]] = strength.get(label[x], 0.0) + w
            pair = tuple(sorted((label[u], label[v])))
            between[pair] = between.get(pair, 0.0) + w
        best = {}
        for (u, v), w in between.items():
            gain = w / total - strength[u] * strength[v] / (2 * total * total)
            if u != v and gain > 1e-12:
                for x in (u, v):
                    best[x] = min(best.get(x, (0.0,)), (-gain, u, v))
        new = {v: u for _, u, v in best.values() if best[u] == best[v]}
        if not new:
            return label
        label = {v: new.get(c, c) for v, c in label.items()}


def test_communities_in_arrays_match_plain_rounds(spark, monkeypatch):
    for seed in range(5):
        rng = random.Random(seed)
        pairs = {tuple(sorted(rng.sample(range(40), 2))): float(rng.randint(1, 3)) for _ in range(120)}
        a, b = np.array(list(pairs)).T
        names, codes = np.unique([a, b], return_inverse=True)
        got = searches.communities(*codes.reshape(2, -1), np.array(list(pairs.values())), len(names), sum(pairs.values()), 1e-12)
        assert {int(names[k]): int(names[c]) for k, c in enumerate(got)} == _plain_communities(pairs)
    monkeypatch.setattr(communities, "_joined_modularity", None)
    g, near, _ = _odd_graph(spark)
    want = _plain_communities({(a, b): w for a in near for b, w in near[a].items() if a < b})
    assert {r.node: r.community for r in communities.greedy_modularity(g).collect()} == want
