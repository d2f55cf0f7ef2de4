from __future__ import annotations

import zlib

import numpy as np

from lodestar.llm import quality

from . import cases


def test_held_out_accuracy_and_odd_rows(spark, tmp_path):
    rows = [(k, cases.prose(k, 60) if k % 3 else "junk " * 60, 9.0, 7, "s") for k in range(300)] + [(None, "x", 1.0, 1, "s"), (900, None, 1.0, 1, "s"), (901, "", 1.0, 1, "s"), (902, "y" * 90_000, 1.0, 1, "s")]
    docs = cases.frame(spark, tmp_path / "d", rows, "doc_id long, text string, score double, predicted int, statistics string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), None) for k in range(300)] + [(None, 1, 0), (3, None, 0), (5, 7, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    got = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    assert len(got) == 304 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k].predicted == int(k % 3 > 0) for k in held]) > 0.97
    assert model.rules and len(model.rules) < 60


def test_without_labels_or_rows(spark, tmp_path):
    docs = cases.frame(spark, tmp_path / "d")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.learn(docs, none)
    assert {r.score for r in quality.scored(docs, model).collect()} == {0.5}
    empty = cases.frame(spark, tmp_path / "e", rows=[])
    assert quality.scored(empty, model).count() == 0


def test_compiled_rules_equal_the_fitted_ones(spark, tmp_path):
    docs = cases.frame(spark, tmp_path / "d")
    stats = quality.with_statistics(docs).select("statistics.*").toPandas()
    assert np.isfinite(stats.to_numpy("f8")).all()
    x = stats[list(quality.STATS)].to_numpy("f8")
    y = (x[:, 0] > np.median(x[:, 0])).astype("f8")
    model = quality.fit(x, y)
    margin = model.intercept + sum(w * quality._holds(r, x) for r, w in model.rules)
    got = quality.with_statistics(docs).select(model.score().alias("p")).toPandas()["p"]
    assert np.allclose(sorted(got), sorted(1 / (1 + np.exp(-margin))))


def test_lasso_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (400, 6)).astype("f8")
    y = (rng.random(400) < 1 / (1 + np.exp(-(3 * x[:, 0] - 2 * x[:, 1])))).astype("f8")
    intercept, w = quality.lasso(x, y, 0.02, 2000)
    scale = np.maximum(x.std(0), 0.05)
    p = 1 / (1 + np.exp(-(intercept + x @ w)))
    slope = ((x - x.mean(0)) / scale).T @ (y - p) / len(y)
    assert all(abs(s) <= 0.02 + 1e-3 if abs(v) < 1e-8 else abs(abs(s) - 0.02) < 1e-3 for s, v in zip(slope, w, strict=True))
    assert w[0] > 1 and w[1] < -0.5


def plain_statistics(text):
    """The statistics of a text, letter by letter."""
    import math
    import unicodedata

    text = text or ""
    blanks = " \t\n\v\f\r"
    words, word = [], ""
    for c in text + " ":
        if c in blanks:
            words += [word] if word else []
            word = ""
        else:
            word += c
    lines = [line for line in text.split("\n") if line]
    n, n_words, n_lines = len(text), max(1, len(words)), max(1, len(lines))
    count = lambda test: sum(map(test, text)) / max(1, n)
    return {
        "log_chars": math.log1p(n), "log_words": math.log1p(len(words)), "word_length": n / n_words, "distinct_words": len(set(words)) / n_words,
        "letters": count(lambda c: unicodedata.category(c).startswith("L")), "capitals": count(lambda c: unicodedata.category(c) == "Lu"), "digits": count(lambda c: c in "0123456789"),
        "marks": count(lambda c: c in "!#$%&*+<=>?@^_~\\"), "pipes": count(lambda c: c == "|"), "long_words": sum(len(w) > 15 for w in words) / n_words,
        "repeated_pairs": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n_words, "lines": len(lines) / n_words, "distinct_lines": len(set(lines)) / n_lines,
        "ended_lines": sum(line[-1] in ".!?" for line in lines) / n_lines, "closings": sum(c in ".,;:" for c in text) / n_words,
    }


def test_statistics_match_a_plain_count(spark, tmp_path):
    extra = ["a a a b.\nb\n\nc!", "  \t x|y|| \n#tag <b> ~ ^ \\", "É漢字 ÜBER Straße a" + "b" * 20, "\n\n", "x. \ny.", "1 2 3,;: 4?"]
    rows = [*cases.documents(), *((700 + k, t, "en", "s", 1, 0.0, "x", 1, "y", 0.0, 1) for k, t in enumerate(extra))]
    docs = cases.frame(spark, tmp_path / "d", rows)
    for r in quality.with_statistics(docs).select("text", "statistics").collect():
        want = plain_statistics(r.text)
        assert list(want) == list(quality.STATS)
        for name, value in want.items():
            assert abs(r.statistics[name] - value) < 1e-9, (name, (r.text or "")[:60])


def test_repeated_rows_count_once(spark, tmp_path):
    rows = [(k, cases.prose(k, 40) if k % 2 else "junk " * 40) for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    once = quality.learn(cases.frame(spark, tmp_path / "a", rows, "doc_id long, text string"), labels)
    many = quality.learn(cases.frame(spark, tmp_path / "b", rows * 3 + rows[:40], "doc_id long, text string"), labels.union(labels))
    assert (once.intercept, once.rules) == (many.intercept, many.rules)
