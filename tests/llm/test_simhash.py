from __future__ import annotations

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import simhash
from lodestar.llm.components import connected_components

from . import cases


def brute_print(text, shingle=4):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_their_definition():
    for _, text, *_ in cases.documents():
        assert simhash.fingerprint((text or "").encode(), 4, 1) == [brute_print(text)]


def test_groups_match_all_pairs(spark, tmp_path):
    docs = cases.frame(spark, tmp_path / "d")
    got = {(r.doc_id, r.w0): r.component_id for r in simhash.near_groups(docs, shingle=4, words=1, budget=4).collect()}
    prints = {(r[0], brute_print(r[1])) for r in cases.documents()}
    assert {(d, w & (1 << 64) - 1) for d, w in got} == prints
    union = cases.Union()
    named = [(d, p) for d, p in prints if d is not None]
    for a, p in named:
        for b, q in named:
            if bin(p ^ q).count("1") <= 4:
                union.link(a, b)
    for (d, _), component in got.items():
        if d is not None:
            assert component == union.root(d)


def test_no_link_is_lost_when_tries_are_dealt_again(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3, dtype="i8")
    codes = {int(base[k % 3]) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 7), replace=False)) for k in range(400)}
    rows = list(enumerate(sorted(codes)))
    nodes = spark.createDataFrame(rows, "node long, w0 long")
    links = simhash.near_links(nodes, 1, 4, split=8)
    got = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    union = cases.Union()
    for i, a in rows:
        for j, b in rows[i + 1 :]:
            if bin(a ^ b).count("1") <= 4:
                union.link(i, j)
    assert {i: got.get(i, i) for i, _ in rows} == {i: union.root(i) for i, _ in rows}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 255)), max_size=40), st.integers(0, 4))
def test_walk_finds_the_components_of_each_trie(rows, budget):
    rows = sorted(set(rows))
    group = np.array([g for g, _ in rows], "i8")
    codes = np.array([c << 56 for _, c in rows], "u8").reshape(-1, 1)
    label = simhash.trie_components(group, codes, budget)
    union = cases.Union()
    for i, (g, a) in enumerate(rows):
        for j in range(i):
            if rows[j][0] == g and bin(a ^ rows[j][1]).count("1") <= budget:
                union.link(i, j)
    assert label.tolist() == [union.root(i) for i in range(len(rows))]


def test_near_copies_go_and_the_rest_stays(spark, tmp_path):
    docs = cases.frame(spark, tmp_path / "d")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert 1 in ids and 3 not in ids and 2 not in ids
    assert 9 in ids and 10 not in ids and 11 not in ids
    assert {7, 12, 13, 14, None} <= ids
    assert ids >= {100 + k for k in range(7)}


def test_empty_table(spark, tmp_path):
    docs = cases.frame(spark, tmp_path / "d", rows=[])
    assert simhash.near_groups(docs, shingle=4, words=1, budget=4).count() == 0
    assert simhash.drop_near_copies(docs).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (None, 3)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(50)}
    assert connected_components(links.where(F.lit(False)), "a", "b").count() == 0


def test_similarity_of_eight_tenths_is_caught_and_less_is_not(spark, tmp_path):
    rows = []
    for g in range(12):
        base = cases.prose(700 + g, 400)
        rows += [(100 * g, base), (100 * g + 1, cases.near(base, g, 4)), (100 * g + 2, cases.near(base, g + 50, 40)), (100 * g + 3, cases.prose(900 + g, 400))]

    def shingles(text):
        return set(simhash.shingle_hashes(text.encode(), 5).tolist())

    docs = cases.frame(spark, tmp_path / "d", rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    for d, text in rows:
        base = dict(rows)[d - d % 100]
        similar = len(shingles(text) & shingles(base)) / len(shingles(text) | shingles(base))
        if similar >= 0.85:
            assert got[d] == d - d % 100
        if similar < 0.7:
            assert got[d] == d


def jaccard(a, b):
    x, y = (set(simhash.shingle_hashes(t.encode(), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_documents_that_share_a_repeated_line_are_no_near_copies(spark, tmp_path):
    line = " ".join(f"menu{k}" for k in range(18))
    rows = [(d, " ".join(f"own{d}x{k}" for k in range(104)) + (" " + line) * 10) for d in range(8)]
    rows += [(100, cases.near(rows[0][1], 1, 2))]
    docs = cases.frame(spark, tmp_path / "d", rows, "doc_id long, text string")
    assert jaccard(rows[0][1], rows[1][1]) < 0.3 and jaccard(rows[0][1], rows[8][1]) >= 0.8
    assert {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()} == {d: d for d in range(8)} | {100: 0}


def test_links_are_of_exact_similarity_also_across_chunks(spark, tmp_path):
    rows = [(100 * g + k, cases.near(cases.prose(300 + g, 200), 7 * g + k, k)) for g in range(5) for k in range(12)]
    docs = cases.frame(spark, tmp_path / "d", rows, "doc_id long, text string")
    prints = simhash.fingerprints(docs, 5, 16, distinct=True)
    nodes = prints.select(F.col("doc_id").alias("node"), *(f"w{k}" for k in range(16)))
    chain = spark.createDataFrame([(d, rows[0][0]) for d, _ in rows[1:]], "a long, b long")
    union = cases.Union()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if jaccard(x, y) >= 0.8:
                union.link(a, b)
    for split in (8, 512):
        links = simhash.verified_links(docs, nodes, chain, 5, 16, 1024, 0.8, split=split)
        got = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
        assert {d: got.get(d, d) for d, _ in rows} == {d: union.root(d) for d, _ in rows}


def test_isolated_pairs_of_eight_tenths_are_found(spark, tmp_path):
    rows = []
    for g in range(150):
        own = [f"{g}x{k}" for k in range(184)]
        copy = [*own[:90], *(f"{g}y{k}" for k in range(16)), *own[106:]]
        rows += [(2 * g, " ".join(own)), (2 * g + 1, " ".join(copy))]
    rows += [(900, "a b c d e f g h"), (901, "a b c d e f g h i")]
    assert all(0.8 <= jaccard(rows[k][1], rows[k + 1][1]) < 0.82 for k in range(0, len(rows), 2))
    docs = cases.frame(spark, tmp_path / "d", rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_a_hub_with_low_and_high_neighbours(spark):
    hub = 5000
    links = [(hub, k) for k in range(1, 3000)] + [(hub, 6000 + k) for k in range(3000)] + [(100_000, 100_001)]
    df = spark.createDataFrame(links, "a long, b long")
    names = ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold")
    try:
        for name in names:
            spark.conf.set(name, "-1" if name.endswith("Threshold") else "4k")
        got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    finally:
        for name in names:
            spark.conf.unset(name)
    assert got == {n: 1 for pair in links[:-1] for n in pair} | {100_000: 100_000, 100_001: 100_000}


def test_a_crowded_component_loses_no_link(spark, tmp_path):
    """Two large groups of copies, small ones and single texts, all candidates of each other, in chunks of a few documents."""
    rows = [(k, cases.near(cases.prose(40, 150), k, 1)) for k in range(60)] + [(100 + k, cases.near(cases.prose(41, 150), k, 1)) for k in range(40)]
    rows += [(200 + 10 * g + k, cases.near(cases.prose(60 + g, 150), k, 2)) for g in range(6) for k in range(3)] + [(300 + k, cases.prose(500 + k, 150)) for k in range(9)]
    rows += [(400, cases.near(cases.prose(40, 150), 77, 5))]
    docs = cases.frame(spark, tmp_path / "d", rows, "doc_id long, text string")
    prints = simhash.fingerprints(docs, 5, 16, distinct=True)
    nodes = prints.select(F.col("doc_id").alias("node"), *(f"w{k}" for k in range(16)))
    chain = spark.createDataFrame([(d, rows[0][0]) for d, _ in rows[1:]], "a long, b long")
    union = cases.Union()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[i + 1 :]:
            if jaccard(x, y) >= 0.8:
                union.link(a, b)
    links = simhash.verified_links(docs, nodes, chain, 5, 16, 1024, 0.8, split=6)
    got = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    assert {d: got.get(d, d) for d, _ in rows} == {d: union.root(d) for d, _ in rows}
