from __future__ import annotations

import itertools

import numpy as np

from lodestar.llm import langid

from . import cases

FRENCH = "le la maison est une petite chose dans cette grande ville où nous avons mangé du pain avec notre ami pendant l'été".split()
ENGLISH = "the house is a small thing within this large town where we have eaten some bread with our friend during the summer".split()


def corpus():
    rows = []
    for k in range(120):
        words = np.random.default_rng(k).choice(ENGLISH if k % 2 else FRENCH, 30)
        rows.append((k, " ".join(words), "en" if k % 2 else "fr", "x", 0.0, "y"))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, score double, lang_pred string"


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    emit, moves, start = rng.normal(size=(3, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = [4, 2, 1]
    real = np.arange(4) < np.array(lengths)[:, None]
    got, expected = langid.marginals(emit, real, moves, start)
    want_moves = np.zeros((3, 3))
    for c, n in enumerate(lengths):
        total, mass, pairs = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            weight = np.exp(start[path[0]] + sum(emit[c, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            total += weight
            for t, y in enumerate(path):
                mass[t, y] += weight
            for a, b in itertools.pairwise(path):
                pairs[a, b] += weight
        assert np.allclose(got[c, :n], mass / total)
        want_moves += pairs / total
    assert np.allclose(expected, want_moves)


def test_features_of_a_word_do_not_depend_on_the_others():
    words = ["été", "a", "maison", "漢字", "été" * 9]
    owner, found = langid.features(words)
    for k, word in enumerate(words):
        alone = langid.features([word])[1]
        assert sorted(found[owner == k]) == sorted(alone)
    assert not len(langid.features([])[0])


def test_held_out_documents_and_switched_words(spark, tmp_path):
    docs = cases.frame(spark, tmp_path / "d", corpus(), SCHEMA)
    chain = langid.learn(docs)
    rows = langid.identify(docs, chain).collect()
    assert len(rows) == 120 and all(r.lang_pred == r.lang and 0.8 < r.score <= 1 for r in rows)
    words = [w for w in ENGLISH[:10] + FRENCH[:10] if w.isalpha()]
    likely = langid.Labeller(chain).word_probabilities([words])[0]
    assert [chain.labels[k] for k in likely.argmax(1)] == ["en"] * 10 + ["fr"] * 10
    mixed = cases.frame(spark, tmp_path / "m", [(1, " ".join(words), None, None, 0.0, None), (2, None, None, None, 0.0, None)], SCHEMA)
    runs = {r.doc_id: [(x.first_word, x.last_word, x.lang) for x in r.runs] for r in langid.label_words(mixed, chain).collect()}
    assert runs == {1: [(0, 9, "en"), (10, 19, "fr")], 2: []}


def test_odd_rows(spark, tmp_path):
    chain = langid.train([(t, label) for _, t, label, *_ in corpus()])
    docs = cases.frame(spark, tmp_path / "d")
    rows = langid.identify(docs, chain).collect()
    assert len(rows) == len(cases.documents())
    for r in rows:
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has_letter) and (0 < r.score <= 1 if has_letter else r.score == 0)
    kept = langid.drop_unidentified(docs, chain)
    assert kept.schema == docs.schema and {(r.lang_pred, r.score) for r in kept.collect()} == {("x", 0.5)}
    empty = cases.frame(spark, tmp_path / "e", rows=[])
    assert langid.identify(empty, langid.learn(empty)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(empty)).collect()} == {"und"}


def test_long_texts_are_labelled_in_parts(monkeypatch):
    chain = langid.train([(t, label) for _, t, label, *_ in corpus()])
    text = " ".join(ENGLISH * 30)
    whole = langid.Labeller(chain).label([text, "x", None, " ".join(FRENCH)])
    monkeypatch.setattr(langid, "AT_ONCE", langid.CHAIN * 2)
    parts = langid.Labeller(chain).label([text, "x", None, " ".join(FRENCH)])
    assert [p[0] for p in parts] == [w[0] for w in whole] and np.allclose([p[1] for p in parts], [w[1] for w in whole])


def plain_label(chain, text):
    """Mean forward-backward probabilities of a text, block by block, with plain loops."""
    words = langid.WORD.findall((text or "").lower())
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    k, total = len(chain.labels), [0.0] * len(chain.labels)
    for first in range(0, len(words), langid.CHAIN):
        block = words[first : first + langid.CHAIN]
        gains = []
        for word in block:
            _, slots = langid.features([word], chain.lexicon)
            scores = [float(sum(chain.weights[s, y] for s in slots)) for y in range(k)]
            gains.append([np.exp(s - max(scores)) for s in scores])
        ahead = []
        for t, gain in enumerate(gains):
            now = [gain[y] * (np.exp(chain.start[y]) if t == 0 else sum(ahead[-1][x] * np.exp(chain.moves[x, y]) for x in range(k))) for y in range(k)]
            ahead.append([v / sum(now) for v in now])
        back = [1.0] * k
        for t in range(len(block) - 1, -1, -1):
            both = [ahead[t][y] * back[y] for y in range(k)]
            total = [a + b / sum(both) for a, b in zip(total, both, strict=True)]
            if t:
                back = [sum(np.exp(chain.moves[x, y]) * gains[t][y] * back[y] for y in range(k)) for x in range(k)]
                back = [v / sum(back) for v in back]
    mean = [v / len(words) for v in total]
    best = int(np.argmax(mean))
    return chain.labels[best], mean[best]


def test_tables_are_labelled_as_by_plain_loops(spark, tmp_path):
    chain = langid.train([(t, label) for _, t, label, *_ in corpus()])
    assert chain.lexicon and set(chain.lexicon.values()) == {0, 1}
    rows = [(k, " ".join(np.random.default_rng(k).choice(ENGLISH + FRENCH, 10 + 9 * k)), None, None, 0.0, None) for k in range(12)] + [(50, "été X1 y", None, None, 0.0, None), (51, "12 !", None, None, 0.0, None), (52, None, None, None, 0.0, None)]
    for r in langid.identify(cases.frame(spark, tmp_path / "d", rows, SCHEMA), chain).collect():
        label, score = plain_label(chain, r.text)
        assert r.lang_pred == label and abs(r.score - score) < 1e-5


def test_training_takes_whole_texts_and_one_row_per_id(spark, tmp_path):
    late = " ".join(["zz"] * 300 + ["kwyjibo"] * 40)  # what tells the language comes late
    rows = [(k, late if k % 2 else "zz " * 340, "xx" if k % 2 else "yy", "s", 0.0, "y") for k in range(60)]
    once = langid.learn(cases.frame(spark, tmp_path / "a", rows, SCHEMA))
    assert langid.Labeller(once).label(["kwyjibo kwyjibo"])[0][0] == "xx"
    again = langid.learn(cases.frame(spark, tmp_path / "b", rows * 3, SCHEMA))
    assert np.array_equal(once.weights, again.weights) and once.labels == again.labels
