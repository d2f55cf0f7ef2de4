"""Small tables with everything that a row may have, and brute-force results."""

from __future__ import annotations

import random
import re

WORDS = "the of and river stone weaver lantern copper maple harbour quiet meadow signal winter candle orchard thunder velvet marble drift ember willow canyon falcon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def near(text: str, seed: int, edits: int = 1) -> str:
    rng = random.Random(seed)
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"changed{rng.randrange(99)}"
    return " ".join(words)


def documents() -> list[tuple]:
    """doc_id, text, lang, source, n_chars and columns whose names operators use themselves."""
    long = prose(1, 40_000)
    texts = [
        (1, prose(2, 120)),
        (2, prose(2, 120).replace(" ", "\n", 3)),
        (3, near(prose(2, 120), 9)),
        (4, None),
        (5, ""),
        (6, " \t\n "),
        (7, "word"),
        (8, "WORD"),
        (9, long),
        (10, long),
        (11, near(long, 4, 5)),
        (12, prose(3, 3)),
        (13, "1234 5678 !!! ---"),
        (14, "É à la maison, où l'été était déjà ça. Ünïcode — ☃ 漢字 test"),
        (14, "É à la maison, où l'été était déjà ça. Ünïcode — ☃ 漢字 test"),
        (None, prose(5, 50)),
        (None, None),
        (15, prose(5, 50)),
        (16, "x" * 30_000 + " " + "7" * 20_000 + " a@" + "b" * 9_000),
        (17, "special <|endoftext|> token and \x00 nul"),
    ]
    texts += [(100 + k, prose(50 + k % 7, 30)) for k in range(21)]
    return [(d, t, "en" if d is None or d % 2 else "fr", "s", len(t or ""), 0.5, "x", 1, "y", 2.5, 3) for d, t in texts]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, component_id long, hit_spans string, row double, hit_items int"


def frame(spark, path, rows=None, schema=SCHEMA, parts=3):
    """The rows as a Parquet table, read again."""
    target = f"file://{path}"
    spark.createDataFrame(documents() if rows is None else rows, schema).repartition(parts).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


class Union:
    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def link(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
