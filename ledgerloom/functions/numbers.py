"""Arithmetic of sizes, tokens and waiting times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a token, tokens a minute, and tokens of a page of 50 KiB. Fixed values.
CHARS_PER_TOKEN, TOKENS_PER_MINUTE, TOKENS_PER_PAGE, PAGE_KIB = 4, 125000, 258, 50


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def share(part: Column, whole: Column) -> Column:
    """part / whole in per cent, 0 where whole is 0."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def relative_difference(a: Column, b: Column) -> Column:
    return F.try_divide(F.abs(a - b), F.greatest(a, b))


def retry_seconds(size_mb: Column, attempt: Column) -> Column:
    """Seconds to wait after a token limit: time for the file's tokens, doubled with each attempt, and a buffer."""
    tokens = F.floor(size_mb * 1024 * 1024 / CHARS_PER_TOKEN)
    return F.floor((tokens / TOKENS_PER_MINUTE * F.pow(F.lit(2.0), attempt) + 1 + attempt) * 60).cast("long")


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN)


def page_tokens(size_mb: Column) -> Column:
    return F.floor(size_mb * 1024 / PAGE_KIB) * TOKENS_PER_PAGE


def time_limit(size_mb: Column) -> Column:
    """Seconds that an extraction may take, by the size of its file."""
    return F.when(size_mb > 8, 1200).when(size_mb > 5, 900).otherwise(600)


def ratio_class(ratio: Column) -> Column:
    """large over 2, small under 0.5, else similar; none for a ratio of 0."""
    return F.when(ratio > 2, "large").when((ratio < 0.5) & (ratio > 0), "small").when(ratio > 0, "similar")
