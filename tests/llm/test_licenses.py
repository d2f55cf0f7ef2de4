from __future__ import annotations

from lodestar.llm import licenses
from lodestar.llm.queries import op10_licenses

from . import cases

TEXTS = ["CC BY, cc-by CC  BY.", "all rights reserved", "All Rights Reserved all rights\nreserved", "xcc by cc byx", "general public license", "Licensed under the Apache License, Version 2.0.", "Licenced under the Apache Licence Version 2.0", "Released under teh MIT License", "Licensed under CC BY-NC 4.0", "licensed under CC BY-SA 4.0", "apache"]


def brute(text):
    words = cases.words(text)
    found = []
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        found += [(k, label) for k in range(len(words)) if words[k : k + len(own)] == own]
    starts = [k for k, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in found}))


def test_base_columns_match_brute_force(spark, tmp_path):
    rows = [*cases.documents(), *((500 + k, cases.prose(k, 8) + " " + t + " " + cases.prose(k, 4), "en", "s", 1, 0.0, "x", 1, "y", 0.0, 1) for k, t in enumerate(TEXTS))]
    cases.frame(spark, tmp_path / "documents.parquet", rows)
    got = op10_licenses(spark, f"file://{tmp_path}").collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((d, *brute(t or "")) for d, t, *_ in rows), key=str)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for r in got:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    want = {505: "apache-2.0", 506: "apache-2.0", 507: "mit", 508: "cc-by,cc-by-nc-4.0", 509: "cc-by,cc-by-sa-4.0", 510: "", 7: ""}
    assert {k: by_id[k].labels for k in want} == want
    assert by_id[505].score == 1 and 0 < by_id[506].score < 1


def test_every_notice_within_its_edits_is_found_with_its_span():
    scanner = licenses.scanner(licenses.PHRASES, licenses.NOTICES)
    for notice in scanner.notices:
        for at in range(0, len(notice.text), 5):
            damaged = notice.text[:at] + b"#"[:0] + notice.text[at + 1 :]
            text = b" river stone " + damaged + b" the meadow "
            found = list(scanner.fuzzy(text))
            assert any(label == notice.label and abs(start - 13) <= notice.edits for start, _, label, _ in found), (notice.text, at, found)


def test_empty_table(spark, tmp_path):
    assert licenses.scan(cases.frame(spark, tmp_path / "d", rows=[])).count() == 0


def distance(a, b):
    """Levenshtein distance of two strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_damaged_notices_are_found_with_no_more_edits_than_made():
    import random

    rng = random.Random(8)
    scanner = licenses.scanner(licenses.PHRASES, licenses.NOTICES)
    for notice in scanner.notices:
        for edits in range(notice.edits + 1):
            letters = list(notice.text.decode())
            for _ in range(edits):  # letters only, so that the words stay
                at = rng.choice([k for k, c in enumerate(letters) if c != " " and 0 < k < len(letters) - 1])
                letters[at : at + 1] = rng.choice([[], [letters[at], "q"], ["q"]])
            damaged = " ".join("".join(letters).split())
            text = f" river stone {damaged} the meadow ".encode()
            found = list(scanner.fuzzy(text))
            made = distance(damaged, notice.text.decode())
            assert found, (notice.text, damaged)
            for start, end, label, n in found:
                own = [x for x in scanner.notices if x.label == label]
                assert min(distance(text[start:end].decode(), x.text.decode()) for x in own) <= n <= max(x.edits for x in own)
            best = min(n / len(notice.text) for _, _, _, n in found)
            assert best <= made / len(notice.text) + 1e-9


def test_one_edit_too_many_is_not_found():
    scanner = licenses.Scanner({}, {"released under the mit license": "mit"})
    (notice,) = scanner.notices
    assert list(scanner.fuzzy(b" relxased undqr the mit license ")) and notice.edits == 2
    assert not list(scanner.fuzzy(b" relxased undqr thz mit license ")) and not list(scanner.fuzzy(b"  "))


def test_phrases_and_notices_of_long_and_repeated_texts(spark, tmp_path):
    text = ("Released under the MIT License. " * 3 + cases.prose(1, 3000) + " ") * 3
    docs = cases.frame(spark, tmp_path / "d", [(1, text), (1, text), (2, None)], "doc_id long, text string")
    got = licenses.scan(docs).collect()
    words = cases.words(text)
    starts = [k for k in range(len(words)) if words[k : k + 5] == "released under the mit license".split()]
    for r in got:
        assert r.doc_id == 2 or [h.label for h in r.hits if h.first_word in starts and h.last_word == h.first_word + 4].count("mit") >= 1
