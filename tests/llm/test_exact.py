from __future__ import annotations

import collections
import hashlib
import re

import xxhash

from lodestar.llm import exact

from . import cases


def brute(rows):
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    out = collections.Counter()
    for text, ids in groups.items():
        named = [d for d in ids if d is not None]
        keep = min(named) if named else None
        first = True
        for d in ids:
            kept = first and d == keep
            first = first and not kept
            out[d, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def test_groups_match_brute_force(spark, tmp_path):
    docs = cases.frame(spark, tmp_path / "d")
    for budget in (exact.TABLE_BYTES, 1500):  # the small budget spills
        got = exact.duplicate_groups(docs, budget).collect()
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == brute(cases.documents())


def test_grace_compares_contents_when_hashes_are_equal():
    records = [(7, b"a%d" % (k % 5), k) for k in range(50)] + [(xxhash.xxh64_intdigest(b"z"), b"z", 50)]
    found = [(table.contents[e], tags) for table, own in exact.grace(iter(records), budget=100) for e, tags in enumerate(own)]
    assert sorted((c, len(t)) for c, t in found) == [(b"a%d" % k, 10) for k in range(5)] + [(b"z", 1)]


def test_grace_spills_and_loses_nothing():
    contents = [b"%d" % (k * k % 997) * 20 for k in range(3000)]
    records = [(xxhash.xxh64_intdigest(c), c, k) for k, c in enumerate(contents)]
    found = {t for _, own in exact.grace(iter(records), budget=4000) for tags in own for t in tags}
    entries = [table.contents[e] for table, own in exact.grace(iter(records), budget=4000) for e in range(len(own))]
    assert found == set(range(3000)) and sorted(entries) == sorted(set(contents))


def test_first_rows_stay(spark, tmp_path):
    docs = cases.frame(spark, tmp_path / "d")
    kept = exact.drop_duplicates(docs)
    assert kept.schema == docs.schema
    rows = kept.collect()
    assert {r.row for r in rows} == {2.5}
    assert len(rows) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in rows}) == len(brute_texts())
    assert [r.doc_id for r in rows].count(14) == 1


def brute_texts():
    return {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in cases.documents()}


def test_empty_table(spark, tmp_path):
    docs = cases.frame(spark, tmp_path / "d", rows=[])
    assert exact.duplicate_groups(docs).count() == 0 and exact.drop_duplicates(docs).count() == 0


def test_rows_do_not_depend_on_how_scans_are_split(spark, tmp_path):
    """Executors that come and go change the default parallelism, and with it the splits, between two scans of the same files."""
    rows = [(k, f"text {k % 40}") for k in range(200)]
    docs = cases.frame(spark, tmp_path / "d", rows, "doc_id long, text string", parts=7)
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    try:
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
        kept = exact.drop_duplicates(docs)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "64")
        spark.conf.set("spark.sql.files.minPartitionNum", "64")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    finally:
        for name in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(name)
        if before:
            spark.conf.set("spark.sql.files.minPartitionNum", before)


def test_copies_count_against_the_budget():
    records = [(k % 3, b"t%d" % (k % 3), k) for k in range(9000)]
    found = [(table.contents[e], len(t)) for table, own in exact.grace(iter(records), budget=20_000) for e, t in enumerate(own)]
    assert sorted(found) == [(b"t%d" % k, 3000) for k in range(3)]
