"""Quality classification by a sparse ensemble of rules.

Shallow trees are grown, each on what the trees before it left to explain, over
statistics of whole texts.  Every path from a root is a conjunctive rule; a
lasso logistic regression gives most rules weight zero.  The rules left are
compiled into one Spark column expression, so scoring runs in the JVM.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import fresh, remainder_of_id

#: Labelled documents to learn from, at most; drawn by a hash of the id.
TRAIN_ROWS = 20_000
TREES = 40
DEPTH = 3
#: Share of the labelled rows that a leaf needs.
LEAF_SHARE = 0.005
SHRINK = 0.3
#: Weight of the lasso penalty.
LASSO = 2e-3

#: Names of the statistics, in the order of the vector.
STATS = ("log_chars", "log_words", "word_length", "distinct_words", "letters", "capitals", "digits", "marks", "pipes", "long_words", "repeated_pairs", "lines", "distinct_lines", "ended_lines", "closings")


def with_statistics(docs: DataFrame, name: str = "statistics") -> DataFrame:
    """``docs`` with a struct column ``name`` of :data:`STATS`; a null text counts as empty, every value is finite."""
    whole, own_words, own_lines = (fresh(docs, n) for n in ("__text", "__words", "__lines"))
    out = docs.withColumn(whole, F.coalesce("text", F.lit("")))
    out = out.withColumn(own_words, F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")).withColumn(own_lines, F.filter(F.split(whole, "\n"), lambda w: w != ""))

    def kept(keep: str) -> Column:
        return F.length(F.regexp_replace(whole, f"[^{keep}]+", ""))

    n, n_words, n_lines = F.length(whole).cast("double"), F.size(own_words).cast("double"), F.size(own_lines).cast("double")
    pairs = F.zip_with(F.slice(own_words, 1, F.greatest(F.size(own_words) - 1, F.lit(0))), F.slice(own_words, 2, F.greatest(F.size(own_words), F.lit(1))), lambda a, b: (a == b).cast("int"))

    def share(part: Column, of: Column) -> Column:
        return F.coalesce(part.cast("double") / F.greatest(of, F.lit(1.0)), F.lit(0.0))

    values = {
        "log_chars": F.log1p(n),
        "log_words": F.log1p(n_words),
        "word_length": share(n, n_words),
        "distinct_words": share(F.size(F.array_distinct(own_words)), n_words),
        "letters": share(kept(r"\p{L}"), n),
        "capitals": share(kept(r"\p{Lu}"), n),
        "digits": share(kept("0-9"), n),
        "marks": share(kept(r"!#$%&*+<=>?@^_~\\"), n),
        "pipes": share(kept("|"), n),
        "long_words": share(F.size(F.filter(own_words, lambda w: F.length(w) > 15)), n_words),
        "repeated_pairs": share(F.aggregate(pairs, F.lit(0), lambda a, x: a + x), n_words),
        "lines": share(n_lines, n_words),
        "distinct_lines": share(F.size(F.array_distinct(own_lines)), n_lines),
        "ended_lines": share(F.size(F.filter(own_lines, lambda w: w.rlike(r"[.!?]$"))), n_lines),
        "closings": share(kept(".,;:"), n_words),
    }
    return out.withColumn(name, F.struct(*(values[k].alias(k) for k in STATS))).drop(own_words, own_lines, whole)


# -- growing rules --------------------------------------------------------------


Condition = tuple[int, bool, float]  # statistic, above, threshold


def _split(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, rows: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """The split of ``rows`` with the largest gain of a Newton step: (gain, statistic, threshold)."""
    best = None
    g_all, h_all = slope[rows].sum(), curve[rows].sum()
    for k in range(x.shape[1]):
        v = x[rows, k]
        order = np.argsort(v, kind="stable")
        v, g, h = v[order], np.cumsum(slope[rows][order]), np.cumsum(curve[rows][order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= least) & (len(v) - at - 1 >= least)]
        if not len(at):
            continue
        gain = g[at] ** 2 / (h[at] + 1.0) + (g_all - g[at]) ** 2 / (h_all - h[at] + 1.0) - g_all**2 / (h_all + 1.0)
        top = int(gain.argmax())
        if gain[top] > 1e-6 and (best is None or gain[top] > best[0]):
            best = (float(gain[top]), k, float((v[at[top]] + v[at[top] + 1]) / 2))
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[tuple[Condition, ...]]:
    """The paths of ``trees`` trees, each grown on a half of the rows drawn anew."""
    rng = np.random.default_rng(seed)
    least = max(5, int(LEAF_SHARE * len(y)))
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    margin = np.full(len(y), math.log(mean / (1 - mean)))
    rules: dict[tuple[Condition, ...], None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = y - p, p * (1 - p)
        drawn = rng.random(len(y)) < 0.5
        nodes = [((), np.ones(len(y), bool))]
        while nodes:
            path, inside = nodes.pop()
            found = _split(x, slope, curve, np.flatnonzero(inside & drawn), least) if len(path) < depth else None
            if found is None:
                if path:
                    margin[inside] += SHRINK * slope[inside & drawn].sum() / (curve[inside & drawn].sum() + 1.0)
                continue
            _, k, cut = found
            for above in (False, True):
                rule = (*path, (k, above, cut))
                rules[tuple(sorted(rule))] = None
                nodes.append((rule, inside & ((x[:, k] > cut) == above)))
    return list(rules)


def _holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) == above
    return out


def lasso(features: np.ndarray, y: np.ndarray, penalty: float = LASSO, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty, by accelerated proximal gradient steps."""
    n, k = features.shape
    center, scale = features.mean(0), np.maximum(features.std(0), 0.05)
    z = np.c_[np.ones(n), (features - center) / scale]
    v = np.ones(k + 1)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / float(v @ (z.T @ (z @ v)))
    w = np.zeros(k + 1)
    ahead, t = w, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-z @ ahead))
        new = ahead + rate * (z.T @ (y - p)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    weights = w[1:] / scale
    return float(w[0] - weights @ center), weights


class RuleModel:
    """Rules with their weights."""

    def __init__(self, intercept: float, rules: list[tuple[tuple[Condition, ...], float]]) -> None:
        self.intercept, self.rules = intercept, rules

    def score(self, stats: str = "statistics") -> Column:
        """The probability of label 1 as a column expression over the struct of statistics."""
        terms = []
        for rule, weight in self.rules:
            parts = [(F.col(f"`{stats}`.{STATS[k]}") > cut) if above else (F.col(f"`{stats}`.{STATS[k]}") <= cut) for k, above, cut in rule]
            terms.append(F.when(reduce(lambda a, b: a & b, parts), F.lit(weight)).otherwise(F.lit(0.0)))
        margin = reduce(lambda a, b: a + b, terms, F.lit(self.intercept))
        return 1.0 / (1.0 + F.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """A model from statistics and labels; of one label only, or of none, a constant."""
    if not len(y) or y.min() == y.max():
        mean = float(np.clip((y.sum() + 1) / (len(y) + 2), 1e-3, 1 - 1e-3))
        return RuleModel(math.log(mean / (1 - mean)), [])
    rules = grow_rules(x, y)
    if not rules:
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        return RuleModel(math.log(mean / (1 - mean)), [])
    features = np.stack([_holds(r, x) for r in rules], axis=1).astype("f8")
    intercept, weights = lasso(features, y)
    return RuleModel(intercept, [(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6])


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> RuleModel:
    """A model from at most ``rows`` labelled documents whose crc32(doc_id) mod 5 is not 0.

    Only numbers reach the driver: ``rows`` vectors of statistics.  Labels
    other than 0 and 1 and null ids are ignored; a document labelled twice
    counts with its smaller label, and of rows repeated under one id the one
    with the smallest statistics counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)").where(remainder_of_id("doc_id", 5) != 0)
    drawn = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most `rows` pairs of numbers: a bounded broadcast.
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    one = with_statistics(sample).groupBy("doc_id").agg(F.min("statistics").alias("statistics"), F.first("quality").alias("quality"))
    got = one.select("doc_id", "quality", "statistics.*").toPandas().sort_values("doc_id")
    return fit(got[list(STATS)].to_numpy("f8"), got["quality"].to_numpy("f8"))


def scored(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted (replacing columns of these names); all rows and other columns stay.

    A null text is scored as an empty one, whose statistics are all zero; very
    long texts are scored whole; equal texts get equal scores.
    """
    rest = docs.drop("score", "predicted")
    stats = fresh(rest, "statistics")
    out = with_statistics(rest, stats).withColumn("score", model.score(stats))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop(stats)
