"""Places in an order, without one task over all rows: ranges of the first column are ordered each by itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges, and distinct values that are looked at for each of their bounds.
RANGES, SAMPLE = 200, 20


def range_of(rows: DataFrame, column: str, ranges: int = RANGES) -> Column:
    """The number of a value's range; null is in the first. Bounds come from distinct values chosen by their hash, so every run has the same."""
    known = rows.select(column).where(F.col(column).isNotNull()).distinct()
    seen = sorted(r[0] for r in known.orderBy(F.xxhash64(column), column).limit(ranges * SAMPLE).collect())
    bounds = seen[SAMPLE::SAMPLE]
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(column)))


def _before(rows: DataFrame, amount: Column) -> DataFrame:
    """_range and the sum of amount over the ranges before it: one row a range."""
    sums = rows.groupBy("_range").agg(amount.alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    return F.broadcast(sums.select("_range", F.coalesce(before, F.lit(0)).alias("_before")))


def placed(rows: DataFrame, order: Sequence[str], into: str) -> DataFrame:
    """Adds the 0-based place of each row in the order of its columns (null first), which must decide between all rows."""
    ranged = rows.withColumn("_range", range_of(rows, order[0]))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(into, within).join(_before(ranged, F.count("*")), "_range").withColumn(into, F.col("_before") + F.col(into) - 1).drop("_range", "_before")


def running(rows: DataFrame, column: str, amount: str, into: str) -> DataFrame:
    """Adds the sum of amount over all rows with a smaller value of column, which is distinct and not null."""
    ranged = rows.withColumn("_range", range_of(rows, column))
    within = F.sum(amount).over(Window.partitionBy("_range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1))
    summed = ranged.withColumn(into, F.coalesce(within, F.lit(0))).join(_before(ranged, F.sum(amount)), "_range")
    return summed.withColumn(into, F.col("_before") + F.col(into)).drop("_range", "_before")
