from __future__ import annotations

import collections
import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodestar.llm import packing

from . import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_cover_every_id_once(spark, tmp_path):
    docs = cases.frame(spark, tmp_path / "d")
    rows = packing.pack(docs, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for d, t, *_ in cases.documents():
        ids = tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)
        want[d, len(ids)] += len(ids)
    got = collections.Counter()
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == want
    texts = collections.defaultdict(set)
    for d, t, *_ in cases.documents():
        texts[d].add(t or "")
    for r in rows:
        ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts[r.doc_id]]
        assert r.ids_crc32 in {zlib.crc32(np.array(i[r.start : r.start + r.length], "<u4").tobytes()) for i in ids}
    with_ids = packing.pack(docs, PATH, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in with_ids) and len(with_ids) == len(rows)
    windows = collections.defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
    not_full = sum(sum(n for _, n in p) < packing.CAPACITY for p in windows.values())
    assert not_full <= 1


def test_encoder_equals_the_tokenizer_file():
    tokenizer, encode = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    texts = [t or "" for _, t, *_ in cases.documents()] + ["don't  stop\n\n\t now   ", "a　b c", "½ ² ٣ 𝟘 ǅ", "<|endoftext|><|endoftext|>x", "\r\n \r", "é ​﻿"]
    for text in texts:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_placement_leaves_the_smallest_sum_of_squares():
    rng = np.random.default_rng(1)
    packer = packing.SumOfSquares(16)
    for size in rng.integers(1, 16, 300):
        before = packer.level.copy()
        costs = []
        for h in range(16):
            if h + size <= 16 and (h == 0 or before[h]):
                after = before.copy()
                after[h] -= h > 0
                after[h + size] += 1
                costs.append(int((after[1:16] ** 2).sum()))
        packer.place([packing.Piece(1, 1, 0, np.zeros(size, "u4"))])
        assert int((packer.level[1:16] ** 2).sum()) == min(costs)
        assert packer.level[16] == 0
    open_tokens = sum(fill * len(w) for fill, w in packer.open.items())
    closed = [sum(len(p.ids) for p in w) for w in packer.close()]
    assert sum(closed) == open_tokens and sum(c < 16 for c in closed) <= 1


def test_windows_of_many_splits_are_carried(spark, tmp_path):
    rows = [(k, cases.prose(k, 40 + 37 * k % 400)) for k in range(400)]
    docs = cases.frame(spark, tmp_path / "d", rows, "doc_id long, text string", parts=8)
    got = packing.pack(docs, PATH, capacity=256).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.sequence_id] += r.length
    assert sum(n < 256 for n in sizes.values()) <= 1 and max(sizes.values()) == 256
    tails = collections.Counter(r.doc_id for r in got if r.length % 256)
    uncut = collections.Counter(r.doc_id for r in got if r.length % 256 == r.doc_tokens % 256)
    assert sum(uncut.values()) >= 0.85 * len(tails)


def test_merges_out_of_order_are_refused(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    merges = spec["model"]["merges"]
    merges[0], merges[-1] = merges[-1], merges[0]
    path = tmp_path / "swapped.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="order of the merges"):
        packing.Encoder(str(path))


def test_empty_table(spark, tmp_path):
    assert packing.pack(cases.frame(spark, tmp_path / "d", rows=[]), PATH).count() == 0
