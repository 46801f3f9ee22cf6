"""Checks of an extracted table: duplicates, missing kinds of rows, empty rows, completeness of documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of rows that every agreement should have. Fixed values.
EXPECTED = ("wage", "pension", "leave", "termination", "overtime", "training", "homeoffice")


def duplicates(rows: DataFrame, keys: Sequence[str], kind: str, file: str, position: str, excluded: str = "wage", samples: int = 5) -> DataFrame:
    """Keys with more than one row: how many, the first row's file and the first positions. One kind of rows may repeat."""
    wanted = rows.where(F.lower(kind) != excluded)
    counted = wanted.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(file, position).alias("first_file")).where("n > 1")
    # Only the first positions of a key are gathered: tasks cut the rest off before they are shuffled.
    first = wanted.withColumn("_no", F.row_number().over(Window.partitionBy(*keys).orderBy(position))).where(F.col("_no") <= samples)
    first = first.groupBy(*keys).agg(F.array_sort(F.collect_list(position)).alias("positions"))
    same = [counted[k].eqNullSafe(first[k]) for k in keys]
    return counted.join(first, same).select(*(counted[k] for k in keys), "n", "first_file", "positions")


def missing_kinds(rows: DataFrame, key: str, kind: str, expected: Sequence[str] = EXPECTED) -> DataFrame:
    """Keys that lack some expected kind, with those that are missing and present; case is ignored."""
    found = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(F.lower(kind))).alias("present"))
    lacking = F.array_except(F.array(*map(F.lit, expected)), "present")
    return found.select(key, F.array_sort(lacking).alias("missing"), "present").where(F.size("missing") > 0)


def empty_rows(rows: DataFrame, key: str, kind: str, empty: Column) -> DataFrame:
    """For each key and kind the rows, the empty ones, and whether all rows of the key that are no wages are empty."""
    flagged = rows.where(F.col(key).isNotNull()).withColumn("_empty", empty)
    each = flagged.groupBy(key, kind).agg(F.count("*").alias("n"), F.count_if("_empty").alias("n_empty"))
    others = flagged.where(F.lower(kind) != "wage").groupBy(key).agg(F.bool_and("_empty").alias("others_all_empty"))
    return each.join(others, key, "left")


def completeness(documents: DataFrame, key: str, fields: str, empty) -> DataFrame:
    """fields: a map column. Number of fields, of filled ones, per cent filled and the empty ones' names, of each document."""
    names = F.map_keys(F.map_filter(fields, lambda k, v: empty(v)))
    n, lost = F.size(F.map_keys(fields)), F.size(names)
    share = F.coalesce(F.try_divide((n - lost) * F.lit(100.0), n), F.lit(0.0))
    return documents.select(key, n.alias("n_fields"), (n - lost).alias("n_filled"), share.alias("per_cent"), F.array_sort(names).alias("empty_fields"))


def empty_fields(complete: DataFrame, top: int | None = None) -> DataFrame:
    """How often each field is empty, most often first; top is the number of fields of a report."""
    counted = complete.select(F.explode("empty_fields").alias("field")).groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field")
    return counted.limit(top) if top else counted
