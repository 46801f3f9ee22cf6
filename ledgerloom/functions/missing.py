"""Five definitions of a missing value, kept apart on purpose: the analyses that use them differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for nothing. Fixed values of each definition.
PLACEHOLDERS = ("", " ", "Empty")
CELL_PLACEHOLDERS = ("", "Empty")
JSON_WORDS = ("empty", "null", "none")


def has_text(value: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(value.cast("string").rlike(r"(?U)\S"), F.lit(False))


def is_placeholder(value: Column, words: Sequence[str] = PLACEHOLDERS) -> Column:
    """Null, or one of the placeholder texts as it stands."""
    return value.isNull() | value.cast("string").isin(*words)


def is_truthy(value: Column) -> Column:
    """Neither null nor the empty text; a blank counts as a value."""
    return F.coalesce(value.cast("string") != "", F.lit(False))


def is_json_empty(document: Column) -> Column:
    """Of a JSON text: null, a blank string, a string that says so, or an empty list or object. Numbers and false are values."""
    value = F.try_parse_json(document)
    kind = F.schema_of_variant(value)
    said = F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull() | F.is_variant_null(value), True)
        .when(kind == "STRING", ~has_text(said) | F.lower(said).isin(*JSON_WORDS))
        .when(kind.startswith("ARRAY"), F.to_json(value) == "[]")
        .when(kind.startswith("OBJECT"), F.to_json(value) == "{}")
        .otherwise(False)
    )


def any_content(columns: Sequence[str], words: Sequence[str] = PLACEHOLDERS) -> Column:
    """A row has some cell that is no placeholder."""
    return F.exists(F.array(*(F.col(c).cast("string") for c in columns)), lambda c: ~is_placeholder(c, words))


def row_is_empty(columns: Sequence[str]) -> Column:
    """All cells null, or all cells the empty text; a row that mixes both is not empty."""
    cells = F.array(*(F.col(c).cast("string") for c in columns))
    return F.forall(cells, lambda c: c.isNull()) | F.forall(cells, lambda c: F.coalesce(c == "", F.lit(False)))


def missing_keys(document: Column, required: Sequence[str]) -> Column:
    """Of a JSON object's text, the required keys that it lacks, in order; null for a text that is no JSON object."""
    keys = F.when(F.try_parse_json(document).isNotNull(), F.json_object_keys(document))
    lacking = F.filter(F.array(*map(F.lit, required)).cast("array<string>"), lambda k: ~F.array_contains(keys, k))
    return F.when(keys.isNotNull(), lacking)


def has_keys(document: Column, required: Sequence[str]) -> Column:
    """Whether a text is a JSON object with all required keys."""
    return F.coalesce(F.size(missing_keys(document, required)) == 0, F.lit(False))
