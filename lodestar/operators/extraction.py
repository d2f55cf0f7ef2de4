"""Lenient JSON and scorer training, where Spark has no expression for them."""

from __future__ import annotations

import ast
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

def repaired(text: str | None) -> str | None:
    """A JSON document from a reply: without fences, the first balanced block, control characters and stray escapes mended; Python literals too."""
    if not text:
        return None
    body = re.sub(r"^\s*```(?:json)?|```\s*$", "", text.strip())
    start = next((i for i, c in enumerate(body) if c in "{["), None)
    if start is None:
        return None
    depth, quoted, escaped, end = 0, False, False, len(body)
    for i in range(start, len(body)):
        c = body[i]
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                end = i + 1
                break
    block = re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", body[start:end])
    for attempt in (lambda: json.loads(block, strict=False), lambda: ast.literal_eval(body[start:end])):
        try:
            return json.dumps(attempt(), ensure_ascii=False, sort_keys=True)
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            continue
    return None


@pandas_udf(StringType())
def repair_json(texts: pd.Series) -> pd.Series:
    return pd.Series([repaired(t) for t in texts], dtype=object)


def compacted(value):
    """A JSON value without nulls, blank strings and what is empty after that, at any depth of its objects; lists lose their empty items."""
    if isinstance(value, dict):
        inner = {k: compacted(v) for k, v in value.items()}
        return {k: v for k, v in inner.items() if v not in (None, "", [], {})}
    if isinstance(value, list):
        return [v for v in value if v not in (None, "", [], {})]
    return value


def as_text(value) -> str:
    """A JSON value as text: strings stripped, lists joined by "; ", objects by their text-like field or as name: value."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, list):
        return "; ".join(t for t in map(as_text, value) if t)
    if isinstance(value, dict):
        for name in ("text", "label", "name", "value", "title"):
            if name in value:
                return as_text(value[name])
        return "; ".join(f"{k}: {t}" for k, v in value.items() if (t := as_text(v)))
    return str(value)


def _over_json(function):
    @pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            try:
                out.append(function(json.loads(text)) if text is not None else None)
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run


#: JSON columns, in Arrow batches: nesting has no depth that an expression could follow.
compact_json = _over_json(lambda value: json.dumps(compacted(value), ensure_ascii=False, sort_keys=True))
text_of_json = _over_json(as_text)


@pandas_udf(StringType())
def ascii_slug(texts: pd.Series) -> pd.Series:
    """Lower case, accents off, runs of other letters one hyphen; "item" if nothing is left."""
    import unicodedata

    def one(text: str | None) -> str:
        plain = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
        return re.sub(r"[^a-z0-9]+", "-", plain).strip("-") or "item"

    return texts.map(one)


def train_scorer(rows: DataFrame, features: list[str], label: str, epochs: int = 500, rate: float = 0.01, l2: float = 0.01, most: int = 100_000) -> tuple[float, list[float]]:
    """Bias and weights of a class-balanced logistic regression by full-batch gradient descent on the driver.

    Each epoch would cost a pass over the table, so at most ``most`` labelled
    rows of numbers, drawn by a hash of their values, reach the driver.
    """
    picked = rows.select(*features, label).where(F.col(label).isNotNull()).orderBy(F.xxhash64(*features, label)).limit(most).toPandas()
    x, y = picked[features].to_numpy("f8"), picked[label].to_numpy("f8")
    w, b = np.zeros(x.shape[1]), 0.0
    if not len(y):
        return b, w.tolist()
    n1 = max(1.0, float(y.sum()))
    n0 = max(1.0, float(len(y) - y.sum()))
    weight = np.where(y > 0.5, len(y) / (2 * n1), len(y) / (2 * n0))
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        slope = weight * (p - y)
        w -= rate * (x.T @ slope / len(y) + l2 * w)
        b -= rate * float(slope.mean())
    return b, w.tolist()
