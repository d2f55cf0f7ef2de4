from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import decontaminate

from . import cases


def brute(text, items, window=10):
    words, hit, found = cases.words(text), set(), set()
    for item, passage in items:
        own = cases.words(passage)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == own[i : i + size]:
                    hit |= set(range(j, j + size))
                    found |= {item} - {None}
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


ITEMS = [(1, cases.prose(2, 120).split(" ", 60)[-1]), (2, "river"), (3, None), (4, " .,! "), (5, "Maple, HARBOUR"), (None, "candle"), (20, cases.prose(3, 3)), (20, cases.prose(3, 3)), (6, "l'été était")]


def test_digests_match_brute_force(spark, tmp_path):
    docs = cases.frame(spark, tmp_path / "d")
    items = spark.createDataFrame([(i, t, "clash") for i, t in ITEMS], "item_id long, text string, hit_spans string")
    want = sorted(((d, *brute(t, ITEMS)) for d, t, *_ in cases.documents()), key=str)
    for block in (decontaminate.BLOCK_BYTES, 40):  # the small block takes several passes
        got = decontaminate.passage_digests(decontaminate.find_passages(docs, items, block_bytes=block)).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    kept = decontaminate.drop_contaminated(docs, items)
    assert {(r.hit_spans, r.hit_items) for r in kept.collect()} == {("y", 3)}
    assert kept.schema == docs.schema and kept.count() == sum(not w[-1] for w in want)


def test_empty_tables(spark, tmp_path):
    docs = cases.frame(spark, tmp_path / "d", rows=[])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find_passages(docs, items).count() == 0
    full = cases.frame(spark, tmp_path / "f")
    assert decontaminate.drop_contaminated(full, items.limit(0)).count() == full.count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), max_size=5), st.integers(1, 4))
def test_search_finds_every_occurrence(words, passages, window):
    text, items = " ".join(words), [(k, " ".join(p)) for k, p in enumerate(passages)]
    tables = decontaminate.searchers([(i, t.encode()) for i, t in items], window)
    spans = [(s, s + t.length) for t in tables for s, _ in t.search(decontaminate.words_of(text.encode()))]
    ids = {i for t in tables for _, own in t.search(decontaminate.words_of(text.encode())) for i in own}
    n, hit, n_items, _, _ = brute(text, items, window)
    assert (len(words), sum(b - a for a, b in decontaminate._merged(spans)), len(ids)) == (n, hit, n_items)


def test_passes_over_many_blocks_hold_one_table_each(spark, tmp_path):
    docs = cases.frame(spark, tmp_path / "d", [(k, cases.prose(k, 40)) for k in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(k, cases.prose(k, 40)) for k in range(0, 60, 2)], "item_id long, text string")
    found = decontaminate.find_passages(docs, items, block_bytes=300)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # what earlier blocks gave is read from a written table
    assert {r.doc_id: r.hit_items for r in found.collect()} == {k: [k] if k % 2 == 0 else [] for k in range(30)}
