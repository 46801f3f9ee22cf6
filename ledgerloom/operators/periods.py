"""Validity periods of an agreement: gaps, renewals and coverage.

A period is a row with a key, a start date and an end date. All functions take the column names, so that any
table of intervals can be used. Gaps and renewals of a key need only that key's rows: one exchange on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days of an average month. Fixed value.
DAYS_PER_MONTH = 30.4375

from ledgerloom.operators.ranges import running


def months(days):
    return days / F.lit(DAYS_PER_MONTH)


def with_gaps(periods: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Adds reach (the latest end before this row) and gap_days.

    A gap exists only where a period starts strictly after everything before it has ended, so a period that starts
    the day after the last one ended counts one day. Rows without key, start or end are dropped.
    """
    order = Window.partitionBy(key).orderBy(start, end, tie)
    rows = periods.dropna(subset=[key, start, end])
    rows = rows.withColumn("reach", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.withColumn("gap_days", F.when(F.col(start) > F.col("reach"), F.datediff(start, "reach")))


def gaps(periods: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    found = with_gaps(periods, key, start, end, tie).where("gap_days is not null")
    return found.select(
        key, F.col("reach").alias("gap_start"), F.col(start).alias("gap_end"), "gap_days", months(F.col("gap_days")).alias("gap_months")
    )


def renewals(periods: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    """Each period with its predecessor by start; gap_days may be negative where they overlap."""
    order = Window.partitionBy(key).orderBy(start, tie)
    rows = periods.dropna(subset=[key, start, end]).withColumn("previous_end", F.lag(end).over(order))
    days = F.datediff(start, "previous_end")
    return rows.where("previous_end is not null").select(
        key, tie, "previous_end", F.col(start).alias("renewal_start"), days.alias("renewal_days"), months(days).alias("renewal_months")
    )


def coverage(periods: DataFrame, key: str, start: str, end: str, tie: str) -> DataFrame:
    rows = with_gaps(periods, key, start, end, tie)
    summed = rows.groupBy(key).agg(
        F.min(start).alias("earliest_start"),
        F.max(end).alias("latest_end"),
        F.count("*").alias("num_files"),
        F.count("gap_days").alias("num_gaps"),
        F.coalesce(F.sum("gap_days"), F.lit(0)).alias("total_gap_days"),
    )
    return summed.select(
        "*",
        (F.col("num_gaps") == 0).alias("is_fully_covered"),
        F.round(months(F.datediff("latest_end", "earliest_start")), 6).alias("coverage_months"),
    )


def yearly(periods: DataFrame, start: str, end: str) -> DataFrame:
    """year, starts and ends: periods that start and end in each year that has either, 0 where none."""
    starts = periods.groupBy(F.year(start).alias("year")).agg(F.count("*").alias("starts"))
    ends = periods.groupBy(F.year(end).alias("year")).agg(F.count("*").alias("ends"))
    joined = starts.where("year is not null").join(ends.where("year is not null"), "year", "full_outer")
    return joined.select("year", F.coalesce("starts", F.lit(0)).alias("starts"), F.coalesce("ends", F.lit(0)).alias("ends"))


def densified(counts: DataFrame, column: str, value: str) -> DataFrame:
    """counts with a row for every whole number from the smallest to the largest of column, 0 where there was none."""
    span = counts.agg(F.min(column).alias("a"), F.max(column).alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b")).alias(column))
    return every.join(counts, column, "left").select(column, F.coalesce(value, F.lit(0)).alias(value))


def histogram(rows: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, low, high, n and per_cent of equal-width bins; the last one is closed. One distinct value gets a range of 1 around it."""
    known = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    span = known.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("total"))
    same = F.col("a") == F.col("b")
    span = span.select(F.when(same, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(same, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"), "total")
    width = (F.col("b") - F.col("a")) / bins
    placed = known.join(F.broadcast(span)).withColumn("bin", F.least(F.floor((F.col("x") - F.col("a")) / width), F.lit(bins - 1)).cast("int"))
    counted = placed.groupBy("bin", "a", "b", "total").agg(F.count("*").alias("n"))
    low = F.col("a") + F.col("bin") * width
    return counted.select("bin", low.alias("low"), (low + width).alias("high"), "n", (F.col("n") * 100.0 / F.col("total")).alias("per_cent"))


def average_rank(rows: DataFrame, column: str, into: str) -> DataFrame:
    """Adds the rank of each value, ties sharing the mean of their places. Ranks come from counts of distinct values, summed range by range."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    ranks = running(counts, column, "_n", "_smaller").select(column, (F.col("_smaller") + (F.col("_n") + 1) / 2).alias(into))
    return rows.join(ranks, column, "left")


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """pearson, spearman, slope and intercept of y on x, over rows that have both."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ranked = average_rank(average_rank(both, "x", "rx"), "y", "ry")
    return ranked.agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
