"""Rules that sort out files and texts: validity of files, choice of a page's text, and signs of hidden content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions.numbers import relative_difference

EMPTY_PAGE = "[EMPTY PAGE]"
#: Words that point to notes, and legal terms. Fixed values.
NOTE_WORDS = ("comment", "annotation", "note", "remark", "genoten", "bedongen")
HIDDEN_WORDS = ("comment", "annotation", "note", "remark")
LEGAL_TERMS = ("brutoloon", "arbeidsvoorwaarden", "uitkering", "vakantie", "pensioen")


def file_validity(size: Column, suffix: Column, wanted: str = ".md") -> Column:
    """valid, or the first reason against a file. size: bytes, null if there is no file."""
    return (
        F.when(size.isNull(), "missing").when(size == 0, "empty").when(size < 1024, "too small").when(size > 50 * 1024 * 1024, "too large").when(suffix != wanted, "wrong suffix").otherwise("valid")
    )


def pdf_validity(size: Column, name: Column, head: Column) -> Column:
    """valid, or the first reason against a PDF file: as file_validity, and its first bytes must be those of a PDF."""
    reason = file_validity(size, F.lower(F.regexp_extract(name, r"\.[^.]+$", 0)), ".pdf")
    is_pdf = F.startswith(head, F.lit(b"%PDF").cast("binary"))
    return F.when((reason == "valid") & ~F.coalesce(is_pdf, F.lit(False)), "no PDF header").otherwise(reason)


def page_text(has_images: Column, native: Column, ocr: Column) -> tuple[Column, Column]:
    """A page's text and whether it is recognised text: pages with images or without text of their own are recognised; what is left empty is marked."""
    used = has_images | (F.length(F.coalesce(native, F.lit(""))) == 0)
    found = F.when(used, F.trim(F.coalesce(ocr, F.lit("")))).otherwise(native)
    return F.when(F.length(found) == 0, EMPTY_PAGE).otherwise(found), used & ocr.isNotNull()


def _said(value: Column) -> Column:
    """Texts that report an error count as nothing."""
    return F.when(value.startswith("ERROR"), "").otherwise(F.coalesce(value, F.lit("")))


def _flags(rules: Sequence[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(rule, name) for rule, name in rules)))


def quick_issues(native: Column, layout: Column) -> Column:
    """Names of the signs that a document needs recognition."""
    a, b = F.length(native), F.length(layout)
    return _flags(
        [
            ((a > 0) & (b > 0) & (relative_difference(a, b) > 0.15), "text difference"),
            (F.size(T.long_lines(layout, 150)) > 0, "long lines"),
            (F.size(T.matched_terms(layout, NOTE_WORDS)) > 0, "annotations"),
            (F.size(T.matched_terms(layout, LEGAL_TERMS)) > 3, "legal terms"),
        ]
    )


def _packed(words: Column) -> Column:
    """Words as one text, which takes less room than an array when rows are exchanged."""
    return F.array_join(words, " ")


def native_signs(native: Column, ocr: Column) -> Column:
    """What a document's own text and its recognised text say for hidden_flags, without the layout."""
    native, ocr = map(_said, (native, ocr))
    every = [T.words(x) for x in (native, ocr)]
    own, recognised = map(F.array_distinct, every)
    return F.struct(
        F.length(native).alias("native_size"),
        F.length(ocr).alias("ocr_size"),
        F.try_divide(*map(F.size, every)).alias("ratio"),
        (F.size(F.array_except(own, recognised)) > 10).alias("only_native"),
        _packed(recognised).alias("recognised"),
        _packed(F.array_except(recognised, own)).alias("not_native"),
    )


def layout_signs(layout: Column) -> Column:
    """What the text of a document's layout says for hidden_flags."""
    layout = _said(layout)
    lines = F.split(layout, "\n")
    first_long = F.array_position(F.transform(lines, lambda line: F.length(T.strip(line)) > 200), True)
    read = F.when(first_long > 0, F.slice(lines, F.lit(1), F.greatest(first_long - 1, F.lit(0)).cast("int"))).otherwise(lines)
    noted = F.exists(read, lambda line: F.lower(line).rlike("|".join(HIDDEN_WORDS)))
    return F.struct(F.length(layout).alias("layout_size"), (first_long > 0).alias("long_line"), noted.alias("noted"), _packed(F.array_distinct(T.words(layout))).alias("words"))


def hidden_flags(own: Column, layout: Column) -> Column:
    """Names of the signs that a document holds text that one of three readings misses, from native_signs and layout_signs."""
    a, b, c = own["native_size"], layout["layout_size"], own["ocr_size"]
    # No words become a list of one empty word here, which is no more than ten and in no other list.
    over = lambda x, other: F.size(F.array_except(F.split(x, " "), F.split(other, " "))) > 10
    return _flags(
        [
            ((a > 0) & (b > 0) & (relative_difference(a, b) > 0.2), "methods differ"),
            ((a > 0) & (c > 0) & (c / a > 1.5), "more recognised"),
            (b > a * 1.3, "more in layout"),
            (layout["long_line"], "long line"),
            (layout["noted"], "annotation"),
            ((c > 0) & over(own["not_native"], layout["words"]), "only recognised"),
            ((a > 0) & (c > 0) & own["only_native"], "only native"),
            ((a > 0) & (c > 0) & over(layout["words"], own["recognised"]), "only layout"),
            (own["ratio"] > 1.3, "more words native"),
            ((own["ratio"] < 0.7) & (own["ratio"] > 0), "more words recognised"),
        ]
    )


def hidden_issues(native: Column, layout: Column, ocr: Column) -> Column:
    """hidden_flags of three readings in one row."""
    return hidden_flags(native_signs(native, ocr), layout_signs(layout))
