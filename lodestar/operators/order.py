"""Positions and running sums in a global order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.operators.tables import staged


def running(rows: DataFrame, keys: list[str], value: str | None = None) -> DataFrame:
    """``rows`` with __place (from 1) and __before, the sum of ``value`` (else the number) of the rows that come first in the order of ``keys``.

    Rows are dealt to ranges and sorted there; a range starts where the sums of
    the ranges before it end.  Only one row per range is ordered in one task.
    ``keys`` must tell all rows apart, or the order of equal ones is open.
    """
    amount = F.lit(1) if value is None else F.col(value)
    ordered = staged(rows.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ordered")
    sizes = ordered.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"), F.sum(amount).alias("__sum"))
    earlier = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    inside = W.partitionBy("__range").orderBy(*keys)
    placed = ordered.join(F.broadcast(starts), "__range")
    before = F.col("__base") + F.coalesce(F.sum(amount).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumns({"__place": F.col("__first") + F.row_number().over(inside), "__before": before}).drop("__range", "__first", "__base")
