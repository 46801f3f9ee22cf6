"""Comparing two versions of a document's lists at growing tolerance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import dates
from ledgerloom.functions import text as T

#: What is read as a number, a percentage and an amount of money in a text. Fixed values.
NUMBER, PERCENT, MONEY = r"\b(\d+(?:\.\d+)?)\b", r"(\d+(?:\.\d+)?)\s*%", r"[€$£]\s*(\d+(?:,\d{3})*(?:\.\d{2})?)"


def normal(items: Column, item: Callable[[Column], Column], filled_only: bool) -> Column:
    """A sorted list of normalised items; empty ones may be left out before that."""
    if filled_only:
        items = F.filter(items, lambda x: F.coalesce(x != "", F.lit(False)))
    return F.array_sort(F.transform(items, lambda x: item(x)))


def data_of(items: Column) -> Column:
    """Numbers, percentages, amounts and dates in a list of texts, each sorted and distinct."""
    def found(pattern: str) -> Column:
        values = F.flatten(F.transform(items, lambda x: F.regexp_extract_all(x, F.lit(pattern), 1)))
        return F.array_sort(F.array_distinct(F.transform(values, lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("double"))))

    days = F.array_sort(F.array_distinct(F.flatten(F.transform(items, lambda x: dates.all_in(x)))))
    return F.struct(found(NUMBER).alias("numbers"), found(PERCENT).alias("percentages"), found(MONEY).alias("amounts"), days.alias("dates"))


def same_data(a: Column, b: Column) -> Column:
    """Some kind of data is the same in both; two documents without any of a kind agree on it."""
    x, y = data_of(a), data_of(b)
    kinds = ("numbers", "percentages", "amounts", "dates")
    out = normal(a, T.data_only, True) == normal(b, T.data_only, True)
    for kind in kinds:
        out = out | (x[kind] == y[kind])
    return out


def matches(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """For each pair of lists whether they are the same: as bytes, item by item, sorted and trimmed, without empty ones, by words, by meaning, by data."""
    x, y = F.col(a), F.col(b)
    levels = {
        "hash": F.md5(F.to_json(F.struct(x.alias("v")))) == F.md5(F.to_json(F.struct(y.alias("v")))),
        "strict": x == y,
        "flexible": normal(x, T.strip, False) == normal(y, T.strip, False),
        "very_flexible": normal(x, T.collapse, True) == normal(y, T.collapse, True),
        "fuzzy": normal(x, T.fuzzy, True) == normal(y, T.fuzzy, True),
        "meaning": normal(x, T.meaning, True) == normal(y, T.meaning, True),
        "data": same_data(x, y),
    }
    return pairs.select(*keys, *(level.alias(f"{name}_match") for name, level in levels.items()))


def all_match(matched: DataFrame) -> DataFrame:
    """One row: pairs, and for each level whether all of them match."""
    flags = [c for c in matched.columns if c.endswith("_match")]
    return matched.agg(F.count("*").alias("pairs"), *(F.bool_and(c).alias(c.replace("_match", "_all")) for c in flags))


def profile(items: Column, samples: int = 5) -> Column:
    """Number of items, of distinct ones and of repeats, and the first samples (a report's feature)."""
    distinct = F.size(F.array_distinct(items))
    return F.struct(F.size(items).alias("total"), distinct.alias("distinct"), (F.size(items) - distinct).alias("repeats"), F.slice(items, 1, samples).alias("samples"))


def list_differences(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Sizes of both lists, how far apart, whether their profiles and their sets of items are the same."""
    x, y = F.col(a), F.col(b)
    items = lambda c: F.array_sort(F.array_distinct(c))
    return pairs.select(*keys, F.size(x).alias("size_a"), F.size(y).alias("size_b"), F.abs(F.size(x) - F.size(y)).alias("apart"), (profile(x) == profile(y)).alias("same_profile"), (items(x) == items(y)).alias("same_items"))
