"""Keeping one row of each key, numbering rows within keys, and splitting work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.ranges import placed


def keep(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order, which must decide between all rows of a key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def latest(rows: DataFrame, keys: Sequence[str], at: str, position: str) -> DataFrame:
    """The row with the greatest at; of equal ones the first."""
    return keep(rows, keys, [F.desc_nulls_last(at), F.asc(position)])


def last_written(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    return keep(rows, keys, [F.desc(position)])


def first_seen(rows: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    return keep(rows, keys, [F.asc(position)])


def sequence_ids(new: DataFrame, existing: DataFrame, key: str, number: str, order: str, into: str) -> DataFrame:
    """Ids of new rows: the key and a number of at least three digits that goes on after the key's greatest one so far."""
    top = existing.groupBy(key).agg(F.max(number).alias("_top"))
    n = F.coalesce("_top", F.lit(0)) + F.row_number().over(Window.partitionBy(key).orderBy(order))
    padded = F.when(n > 999, n.cast("string")).otherwise(F.lpad(n.cast("string"), 3, "0"))
    return new.join(top, key, "left").withColumn(into, F.concat(F.col(key).cast("string"), padded)).drop("_top")


def unique_names(rows: DataFrame, keys: Sequence[str], name: str, order: str, into: str) -> DataFrame:
    """The first row of a name keeps it; those after it get _1, _2 and so on."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(order)) - 1
    return rows.withColumn(into, F.when(n == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), n.cast("string"))))


def assigned(rows: DataFrame, order: Sequence[str], total: int) -> DataFrame:
    """Adds worker, the row's place in the order modulo total; the order must decide between all rows."""
    return placed(rows, order, "_place").withColumn("worker", (F.col("_place") % total).cast("int")).drop("_place")


def shuffle_key(key: str, seed: int) -> Column:
    """Where a row stands in a seeded order."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """A seeded order of the rows that does not depend on how they are partitioned."""
    return rows.orderBy(shuffle_key(key, seed), key)
