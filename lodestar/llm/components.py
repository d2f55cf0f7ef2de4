"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (with map-side combine), a written table, and
one join of the links with it on the node.  Both sides of the join are plain
reads, so adaptive execution may broadcast the minima or split a hub with very
many links; no group of rows is gathered in a task.  Links stay in written
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import staged


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (a, b), a > b."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(both.select("v", "u"))
    low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u_"), F.least("u", "m").alias("m")), "least")
    joined = both.join(low, both.u == low.u_)
    if large:
        out = joined.where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u_").alias("a"), F.col("m").alias("b")))
    return out.distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): each linked node with the smallest node it reaches.

    Nulls and self links are ignored; repeated links count once; no links give
    an empty result.  The rounds end when a step changes nothing.
    """
    a, b = F.col(left), F.col(right)
    now = staged(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        now = staged(_star(now, large=True), "large-star")
        now = staged(_star(now, large=False), "small-star")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
