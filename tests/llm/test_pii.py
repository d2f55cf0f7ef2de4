from __future__ import annotations

import hashlib
import re

from lodestar.llm import pii

from . import cases

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
TEXTS = [
    "a.b@c.d_e@f.g x@y @z.w a@b.c@d.e é+1@x-y.z",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.0.9 1.2.3 01.2.3.4é 1.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 0000000000000 12 3 4111111111111111 2",
    "+1 (202) 555-0143 +12 +1.2.3.4.5.6.7.8.9 ++49 30 1234567- +1 2) 漢字 +33 1 23 45 67 89",
    'é漢 key: token = "%s" end' % ("0a" * 20),
    "user id AB-1234-XY and user id AB-9999-ZZ", "\x00 1@2.3\n+4 55555555\t6",
]
FRUITS = ["call me at +1 (202) 555-01%02d now" % k for k in range(6)] + ["call me at x55-%d00-q now" % k for k in range(2)]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    spans = []
    for k, (kind, rx) in enumerate(PATTERNS):
        for m in re.finditer(rx, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                spans.append((m.start(), k, m.end()))
    spans.sort()
    return [f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in spans]


def test_base_spans_match_the_plain_patterns(spark, tmp_path):
    rows = [*cases.documents(), *((500 + k, t, "en", "s", 1, 0.0, "x", 1, "y", 0.0, 1) for k, t in enumerate(TEXTS + FRUITS))]
    docs = cases.frame(spark, tmp_path / "d", rows)
    got = pii.digests(pii.find(docs)).collect()
    assert len(got) == len(rows)
    want = sorted(((d, hashlib.sha256(",".join(brute(t or "")).encode()).hexdigest(), *(sum(s.startswith(k) for s in brute(t or "")) for k, _ in PATTERNS)) for d, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got), key=str) == want
    spans = {r.doc_id: r.spans.split(",") for r in got if r.doc_id is not None and r.doc_id >= 500}
    for k, text in enumerate(TEXTS + FRUITS):
        assert set(brute(text)) <= set(spans[500 + k])
    secret = TEXTS[4].index("0a")
    assert f"secret:{secret}:{secret + 40}" in spans[504]


def test_patterns_of_seeds_find_unseen_identifiers(spark, tmp_path):
    seeds = [(k, f"lorem {k} my login code: {k:02d}{'ab3' * 11} thanks {cases.prose(k, 5)}") for k in range(9)]
    docs = cases.frame(spark, tmp_path / "d", [*seeds, (50, "hello my login code: ZX-77-QQ bye"), (51, "hello other code 7777-888 bye")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digests(pii.find(docs)).collect()}
    assert got[50] == "secret:21:29" and got[51] == ""


def test_empty_table(spark, tmp_path):
    assert pii.digests(pii.find(cases.frame(spark, tmp_path / "d", rows=[]))).count() == 0


def test_very_many_matches_in_one_text(spark, tmp_path):
    text = " ".join(f"id{k} é 1.2.3.{k % 256} a{k}@b.org" for k in range(3000))
    docs = cases.frame(spark, tmp_path / "d", [(1, text)], "doc_id long, text string")
    row = pii.digests(pii.find(docs)).first()
    assert row.n_ip == 3000 and row.n_email == 3000 and row.base_sha256 == hashlib.sha256(",".join(brute(text)).encode()).hexdigest()


def plain_find(texts):
    """Added spans of all texts by the same rules, with plain loops."""
    found, graph = [], {}
    for d, text in enumerate(texts):
        base = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0]), int(s.split(":")[2])) for s in brute(text)]
        base.sort(key=lambda b: (b[1], b[0]))
        own = []
        for m in re.finditer(r"(?<!\S)[^\s0-9]*[0-9]\S*", text):
            before = re.sub(r"\s+", " ", text[: m.start()]).rstrip(" ").split(" ")[-2:]
            before = "".join(w + " " for w in before if w).lower()
            hits = [b for b in base if b[0] < m.end() and m.start() < b[2]]
            if hits:
                start, kind, end = hits[0]
                if start < m.start():
                    continue
            else:
                core = re.search(r"(?<![0-9A-Za-z_./+:@-])[A-Za-z_./+:@-]*[0-9][0-9A-Za-z_./+:@-]*", m[0])[0].strip("_./+:@-")
                start = m.start() + m[0].index(core)
                end = start + len(core)
                kind = 4 if re.fullmatch(r"(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,}|AKIA[0-9A-Z]{16}", core) else None
            lead = text[m.start() : start]
            pattern = lead.lower() if any(c.isalpha() for c in lead) else before + lead
            own.append((start, end, text[start:end], pattern, kind))
            if pattern:
                at = graph.setdefault((pattern, text[start:end]), None)
                graph[pattern, text[start:end]] = kind if at is None else at if kind is None else max(at, kind)
        found.append(own)
    seeds = {}
    for (_, value), kind in graph.items():
        if kind is not None:
            seeds[value] = max(kind, seeds.get(value, -1))
    known, trusted = dict(seeds), {}
    for turn in range(pii.ROUNDS):
        after = {}
        for pattern, value in graph:
            after.setdefault(pattern, []).append(known.get(value))
        trusted = {}
        for pattern, kinds in after.items():
            hits, kind = max((kinds.count(k), -k) for k in range(5))
            if hits >= pii.SUPPORT and hits / len(kinds) >= pii.CONFIDENCE:
                trusted[pattern] = (-kind, hits / len(kinds))
        if turn + 1 < pii.ROUNDS:
            scores = {}
            for pattern, value in graph:
                scores.setdefault(value, []).append(trusted.get(pattern))
            known = {}
            for value, marks in scores.items():
                total, kind = max((sum(c for k0, c in filter(None, marks) if k0 == k), -k) for k in range(5))
                if total / len(marks) >= pii.CONFIDENCE:
                    known[value] = -kind
            known |= seeds
    out = []
    for own in found:
        spans = set()
        for start, end, _, pattern, kind in own:
            if kind is None and pattern in trusted:
                spans.add((start, trusted[pattern][0], end))
            elif kind == 4:
                spans.add((start, 4, end))
        out.append(sorted(spans))
    return out


def test_added_spans_match_plain_loops(spark, tmp_path):
    import random

    rng = random.Random(5)
    word = lambda: rng.choice(["red", "key", "id", "call", "at", "my", "code:", "12", "x9"])
    secret = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(18)) + "a1"
    special = [lambda: f"token={secret()}", lambda: f'login "{secret()}"', lambda: f"ring me +1 (202) 555-{rng.randrange(1000, 9999)}", lambda: f"host is {rng.randrange(256)}.1.2.3", lambda: f"token=ZZ-{rng.randrange(99)}", lambda: f"ring me x{rng.randrange(9)}", lambda: f"AKIA{rng.randrange(10**15, 10**16)}"]
    texts = [" ".join(rng.choice(special)() if rng.random() < 0.4 else word() for _ in range(14)) for _ in range(120)]
    docs = cases.frame(spark, tmp_path / "d", list(enumerate(texts)), "doc_id long, text string")
    want = plain_find(texts)
    for r in pii.find(docs).collect():
        assert sorted((x.start, x.kind, x.end) for x in r.found) == want[r.doc_id], texts[r.doc_id]
    assert sum(map(len, want)) > 60
