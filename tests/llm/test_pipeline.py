from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from lodestar.llm import simhash

from . import cases
from .test_decontaminate import brute as passages
from .test_langid import ENGLISH, FRENCH

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(seed, vocabulary, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(vocabulary) + str(rng.randrange(10**4)) * (rng.random() < 0.3) for _ in range(n))


def corpus():
    rows = []
    for k in range(60):
        text = sentence(k, ENGLISH if k % 2 else FRENCH, 150)
        rows.append((k, text, "en" if k % 2 else "fr"))
        if k % 6 == 0:
            rows.append((1000 + k, text.replace(" ", "\t ", 2), "fr"))
        if k % 10 == 1:
            rows.append((2000 + k, cases.near(text, k, 2), "en"))
    rows += [(3000, None, "en"), (3001, "12 34 !!", "fr"), (3002, "", None), (3003, "the house " + sentence(4, ENGLISH, 12) + " of this town", "en")]
    return [(d, t, lang, "s", len(t or "")) for d, t, lang in rows]


def brute(rows, items):
    """What the stages before packing leave, by plain comparisons of all pairs."""
    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    kept, seen = [], set()
    for r in sorted(left):
        text = " ".join(r[1].split())
        if text not in seen:
            seen.add(text)
            kept.append(r)
    sets = {r[0]: set(simhash.shingle_hashes(r[1].encode(), 5).tolist()) for r in kept}
    union = cases.Union()
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                union.link(a, b)
    kept = [r for r in kept if union.root(r[0]) == r[0]]
    return [r for r in kept if not passages(r[1], items)[-1]]


def test_stages_match_brute_force(spark, tmp_path):
    rows = corpus()
    items = [(1, " ".join(rows[8][1].split()[20:45])), (2, "of this town")]
    cases.frame(spark, tmp_path / "documents.parquet", rows, SCHEMA)
    cases.frame(spark, tmp_path / "benchmark.parquet", items, "item_id long, text string", 1)
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    want = brute(rows, items)
    assert {r.doc_id for r in out} == {r[0] for r in want} and len(want) < 62
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        ids = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    docs = cases.frame(spark, tmp_path / "documents.parquet", [], SCHEMA)
    cases.frame(spark, tmp_path / "benchmark.parquet", [], "item_id long, text string", 1)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, f"file://{tmp_path}")
        assert out.count() == 0
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


COLUMNS = {
    "op1": "doc_id fingerprint component_id",
    "op2": "doc_id held_out score predicted",
    "op3": "doc_id n_tokens",
    "op4": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op5": "doc_id keep_id group_size kept text_sha256",
    "op6": "page_id payload_bytes payload_digest record_type refers_to",
    "op7": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op9": "doc_id held_out lang_pred score",
    "op10": "doc_id n_words n_base first_word last_word base_labels labels score",
}


@pytest.mark.parametrize("key", COLUMNS)
def test_queries_return_the_contract(spark, tmp_path, key):
    """Over odd rows in every table that the query reads."""
    rows = [(*r[:5],) for r in cases.documents()]
    cases.frame(spark, tmp_path / "documents.parquet", rows, SCHEMA)
    cases.frame(spark, tmp_path / "benchmark.parquet", [(1, cases.prose(3, 3)), (2, None)], "item_id long, text string", 1)
    cases.frame(spark, tmp_path / "labels.parquet", [(1, 1, 0), (2, 0, 0), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int", 1)
    cases.frame(spark, tmp_path / "pages.parquet", [(1, "u", "x" * 200), (2, None, "x" * 200), (3, "u", None)], "page_id long, url string, html string", 1)
    (name,) = [n for n in __spark_entry__.queries() if n.startswith(f"{key}_")]
    out = __spark_entry__.queries()[name](spark, f"file://{tmp_path}")
    assert out.columns[: len(COLUMNS[key].split())] == COLUMNS[key].split()
    n = out.count()
    assert n == {"op6": 3}.get(key, len(rows)) if key != "op4" else n >= len(rows)


def test_stages_take_odd_rows_and_clashing_names(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, and columns that the operators name themselves."""
    cases.frame(spark, tmp_path / "benchmark.parquet", [(1, cases.prose(3, 3)), (None, None)], "item_id long, text string", 1)
    docs = cases.frame(spark, tmp_path / "d")
    rows = cases.documents()
    stages = dict(corpus_pipeline.STAGES)
    kept = {name: stages[name](spark, docs, f"file://{tmp_path}") for name in list(stages)[:-1]}
    for name, out in kept.items():
        assert out.schema == docs.schema, name
        assert set(map(str, out.collect())) <= set(map(str, docs.collect()))
    texts = [r.text for r in kept["language_id"].collect()]
    assert all(any(c.isalpha() for c in t or "") for t in texts) and len(texts) == sum(any(c.isalpha() for c in r[1] or "") for r in rows)
    assert kept["exact_dedup"].count() == len({" ".join((r[1] or "").split()) + "|" * bool((r[1] or "") and not (r[1] or "").strip()) for r in rows})
    near = [r.doc_id for r in kept["near_dedup"].collect()]
    assert near.count(14) == 2 and near.count(None) == 2 and 10 not in near and 11 not in near and 9 in near
    assert sorted(r.doc_id for r in kept["decontamination"].collect() if r.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None and not passages(r[1], [(1, cases.prose(3, 3))])[-1])
    assert stages["packing"](spark, docs, f"file://{tmp_path}").agg({"length": "sum"}).first()[0] > 40_000
