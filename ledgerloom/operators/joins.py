"""Joins of records with what is known about their agreements, and reconciliation of inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import lookup_key
from ledgerloom.operators.dedupe import first_seen, last_written


def with_info(files: DataFrame, info: DataFrame, name: str, key: str, info_id: str, dates: Sequence[str], position: str) -> DataFrame:
    """files with the id and dates of their agreement's period: looked up by name and key, the last row of info winning.

    Where that finds nothing, names are compared without spaces, hyphens and underscores in lower case; the first row found gives the id only.
    """
    exact = last_written(info, [name, key], position).select(name, key, info_id, *dates)
    loose_name = lookup_key(F.col(name))
    loose = first_seen(info.withColumn("_loose", loose_name), ["_loose", key], position).select("_loose", key, F.col(info_id).alias("_loose_id"))
    joined = files.join(exact, [name, key], "left").withColumn("_loose", loose_name).join(loose, ["_loose", key], "left")
    return joined.withColumn(info_id, F.coalesce(info_id, "_loose_id")).drop("_loose", "_loose_id")


def new_rows(rows: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not there yet; rows with a null in the key are always new."""
    return rows.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def listed(rows: DataFrame, listing: DataFrame, column: str, listed_column: str) -> DataFrame:
    """Rows whose value is listed, without regard to case and surrounding spaces."""
    plain = lambda c: F.lower(F.trim(F.col(c)))
    return rows.withColumn("_plain", plain(column)).join(listing.select(plain(listed_column).alias("_plain")).distinct(), "_plain", "left_semi").drop("_plain")


def kept_if(rows: DataFrame, flag: Column, matched: Column) -> DataFrame:
    """Rows without the flag, and those with it that match."""
    return rows.where(~flag | matched)


def propagated(items: DataFrame, others: DataFrame, key: str, position: str, columns: Sequence[str]) -> DataFrame:
    """items with the last non-empty value of each column among the key's others. One small row for each key is joined, not pairs."""
    last = [F.max_by(c, F.when(F.coalesce(F.col(c) != "", F.lit(False)), F.col(position))).alias(c) for c in columns]
    return items.join(others.groupBy(key).agg(*last), key, "left")


def preferred(rows: DataFrame, candidates: DataFrame, stem: str, suffix: str, wanted: Sequence[str]) -> DataFrame:
    """rows with the candidate of their stem whose suffix comes first in wanted."""
    rank = F.array_position(F.array(*map(F.lit, wanted)), F.col(suffix))
    best = candidates.where(rank > 0).groupBy(stem).agg(F.min_by(suffix, rank).alias(suffix))
    return rows.join(best, stem, "inner")


def both_ways(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has, with side left or right."""
    a, b = (df.select(*keys).where(F.concat(*(F.col(k).cast("string") for k in keys)).isNotNull()).distinct() for df in (left, right))
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))


def reconciled(inventories: dict[str, DataFrame], checks: Sequence[tuple[str, str]], keys: Sequence[str]) -> DataFrame:
    """For each (from, to) the keys of the one inventory that the other lacks."""
    parts = [inventories[a].select(*keys).distinct().join(inventories[b].select(*keys).distinct(), list(keys), "left_anti").withColumn("check", F.lit(f"{a} not in {b}")) for a, b in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unmatched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of left rows that no right row has: what a comparison reports as without a match."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti")


def field_differences(left: DataFrame, right: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """key, field and the values that only the left or only the right rows of a key have, for fields that differ; keys that both have."""
    def values(df: DataFrame, side: int) -> DataFrame:
        long = df.select(*key, *(F.col(c).cast("string").alias(c) for c in fields)).unpivot(list(key), list(fields), "field", "value")
        return long.dropna(subset=list(key)).withColumn("side", F.lit(side))

    # Values that both sides have are gone before any are gathered, however many rows a key has.
    sides = values(left, 1).unionByName(values(right, 2)).groupBy(*key, "field", "value").agg(F.bit_or("side").alias("side"))
    of = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("value"))))
    only = sides.groupBy(*key, "field").agg(F.bit_or("side").alias("both"), of(1).alias("only_left"), of(2).alias("only_right")).where("both = 3").drop("both")
    return only.where((F.size("only_left") > 0) | (F.size("only_right") > 0))
