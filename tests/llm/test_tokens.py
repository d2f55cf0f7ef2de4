from __future__ import annotations

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from lodestar.llm import tokens

from . import cases

PATH = public_tokenizers.path("piece_bpe_32k.model")


def reference(pieces, byte_fallback):
    own = [("<unk>", 0.0)]
    if byte_fallback:
        own += [(f"<0x{b:02X}>", min(s for _, s in pieces)) for b in range(256)]
    tokenizer = Tokenizer(models.Unigram(own + pieces, unk_id=0, byte_fallback=byte_fallback))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_tokenizer(spark, tmp_path):
    docs = cases.frame(spark, tmp_path / "d")
    count = reference(tokens.vocabulary(PATH), True)
    want = sorted(((d, count(t or "")) for d, t, *_ in cases.documents()), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in tokens.token_counts(docs, PATH).collect()), key=str) == want
    assert tokens.token_counts(cases.frame(spark, tmp_path / "e", rows=[]), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("ab▁c", min_size=1, max_size=4), st.sampled_from([-1.0, -2.0, -3.0, -1.5]), min_size=1, max_size=12), st.text("abcd é", max_size=24), st.booleans())
def test_ties_and_unknown_characters(vocabulary, text, byte_fallback):
    pieces = sorted(vocabulary.items())
    assert tokens.UnigramCounter(pieces, byte_fallback).text(text) == reference(pieces, byte_fallback)(text)
