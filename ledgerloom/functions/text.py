"""Text functions, Column to Column. Words are Unicode words: letters, digits and underscore of any script."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a fuzzy comparison ignores. Fixed values.
FILLER_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
#: Words of text that a comparison by meaning ignores besides those above. Fixed values.
STOP_WORDS = (
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "can",
    "must", "shall", "this", "that", "these", "those", "it", "its", "they", "them", "their", "from", "into", "through", "during", "before", "after", "above",
    "below", "up", "down", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "just", "now",
    "also", "well", "even", "still", "back", "like", "way", "year", "day", "time", "work", "people", "man", "woman", "child", "number", "part", "thing",
    "case", "point", "place", "group", "company", "business", "information", "data", "system", "program", "question", "problem", "fact", "government", "hand",
    "eye", "life", "world", "head", "face", "month", "week", "hour", "minute", "second", "morning", "afternoon", "evening", "night", "today", "tomorrow",
    "yesterday",
)
#: Strings that mark a text as holding data. Fixed values.
KEY_INDICATORS = (
    "salary", "wage", "payment", "amount", "cost", "price", "fee", "percentage", "percent", "%", "rate", "increase", "decrease", "duration", "period", "time",
    "month", "year", "week", "day", "date", "deadline", "expiry", "valid", "contract", "agreement", "employee", "worker", "staff", "personnel", "member",
    "benefit", "allowance", "bonus", "compensation", "remuneration", "hour", "overtime", "shift", "schedule", "roster", "leave", "vacation", "holiday", "sick",
    "maternity", "paternity",
)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def column_name(text: Column) -> Column:
    return strip(F.translate(F.lower(strip(text)), "\n\r_", "   "))


def file_key(name: Column) -> Column:
    """A file name without its last extension, as lower-case letters and digits."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\.[^.]+$", ""), "[^a-z0-9]", "")


def lookup_key(name: Column) -> Column:
    return F.lower(F.translate(name, " -_", ""))


def url_unquote(text: Column) -> Column:
    """Decodes %XX; a plus sign stays, and so does a text with a bad escape."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def safe_file_name(text: Column) -> Column:
    return collapse(F.regexp_replace(url_unquote(text), r'[<>:"/\\|?*]', ""))


def url_basename(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]+$", "")


def clean_json_text(text: Column) -> Column:
    """Without lines of code fences and without commas before a closing bracket."""
    plain = F.array_join(F.filter(F.split(strip(text), "\n"), lambda line: ~strip(line).startswith("```")), "\n")
    return F.regexp_replace(plain, r",\s*([}\]])", "$1")


def outermost_object(text: Column) -> Column:
    """From the first to the last brace, without byte order marks and zero-width spaces, curly quotes made straight."""
    plain = F.translate(F.regexp_replace(text, "[﻿​‌‍]", ""), "“”‘’", "\"\"''")
    found = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(plain)


def repair_json(text: Column, keys: Sequence[str], limit: int = 1000) -> Column:
    """A JSON object text: as it is, its outermost object, rebuilt from the lists that are found key by key, or the text's start as a field.

    The limit is a feature of the last resort: it keeps the head of a text that is no JSON at all.
    """
    cleaned = clean_json_text(outermost_object(text))
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    items = [F.regexp_extract(text, rf'(?s)"{key}"\s*:\s*(\[[^\]]*\])', 1) for key in keys]
    fields = [F.when(F.try_parse_json(item).isNotNull(), F.concat(F.lit(f'"{key}": '), item)) for key, item in zip(keys, items, strict=True)]
    rebuilt = F.when(F.coalesce(*fields).isNotNull(), F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ", "), F.lit("}")))
    fallback = F.to_json(F.struct(F.left(text, F.lit(limit)).alias("text")))
    return F.coalesce(valid(strip(text)), valid(cleaned), rebuilt, fallback)


#: A quoted string: a quote of its kind inside it is one that a letter, a digit or one of these characters follows. Fixed values.
_QUOTED = re.compile(r"""(["'])((?:\\.|(?!\1)[^\\]|\1(?=[^\W_]|[ ,.:;()%+/-]))*)""", re.S)
_IN_STRING = re.compile(r"""\\(["\\/bfnrt])|\\|["'\n\r]""")


def _mended(text: str) -> str:
    """Inside quoted strings: line breaks and quotes escaped, and backslashes that escape nothing doubled."""
    named = {"\n": "\\n", "\r": "\\r", "\\": "\\\\"}
    inner = lambda m: m[0] if m[1] else named.get(m[0], "\\" + m[0])
    return _QUOTED.sub(lambda m: m[1] + _IN_STRING.sub(inner, m[2]), text + "\0").removesuffix("\0")


def sanitized_strings(text: Column) -> Column:
    """A malformed JSON text with its strings mended as far as can be told; in Arrow batches, as a string's end depends on all before it."""

    @F.pandas_udf("string")
    def mended(texts: pd.Series) -> pd.Series:
        return texts.map(_mended, na_action="ignore")

    return mended(text)


def picked_text(finish: Column, parsed: Column, text: Column, parts: Column) -> Column:
    """The text of a model's response and how it ended: '' if it was blocked, else what was parsed, the text, or its parts joined; null if there is nothing.

    Joined parts that look like a JSON object and are none lose their control characters, if that makes them one.
    """
    joined = F.nullif(F.array_join(F.array_compact(parts), ""), F.lit(""))
    plain = drop_controls(joined)
    broken = strip(joined).rlike(r"(?s)^\{.*\}$") & F.try_parse_json(joined).isNull() & F.try_parse_json(plain).isNotNull()
    blocked = F.coalesce(~finish.isin("", "STOP", "MAX_TOKENS"), F.lit(False))
    found = F.coalesce(F.nullif(parsed, F.lit("")), F.nullif(text, F.lit("")), F.when(broken, plain).otherwise(joined))
    return F.struct(F.when(blocked, "").otherwise(found).alias("text"), F.coalesce(F.nullif(finish, F.lit("")), F.lit("STOP")).alias("finish"))


def drop_controls(text: Column) -> Column:
    """Without control characters but line feeds; tabs go too."""
    return F.regexp_replace(text, r"[\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")


UNI, GLYPH = "/uni[0-9a-fA-F]{4}/", "/G[0-9]+"


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def replace_matches(text: Column, pattern: str, mark: str, decode: Callable[[Column], Column]) -> Column:
    """text with each match of pattern replaced by decode(match), or left where that is null: what a replacement callback does. Texts without mark have no match."""
    between = F.split(text, pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    new = F.transform(found, lambda m: F.coalesce(decode(m), m))
    return F.when(F.contains(text, F.lit(mark)), F.array_join(F.zip_with(between, F.array_append(new, F.lit("")), lambda a, b: F.concat(a, b)), "")).otherwise(text)


def _utf16(code: Column) -> Column:
    return F.decode(F.unhex(code), "UTF-16BE")


def _code_point(digits: Column) -> Column:
    n = digits.try_cast("bigint")
    good = (n <= 1114111) & ~n.between(55296, 57343)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))


def decode_uni(text: Column) -> Column:
    """Decodes /uniXXXX/, then uniXXXX without slashes."""
    slashed = replace_matches(text, UNI, "/uni", lambda m: _utf16(F.substr(m, F.lit(5), F.lit(4))))
    return replace_matches(slashed, "uni[0-9a-fA-F]{4}", "uni", lambda m: _utf16(F.substr(m, F.lit(4), F.lit(4))))


def decode_glyphs(text: Column) -> Column:
    """Decodes /G and a decimal code point, then G and a code point; those out of range stay."""
    slashed = replace_matches(text, GLYPH, "/G", lambda m: _code_point(F.substr(m, F.lit(3))))
    return replace_matches(slashed, "G[0-9]+", "G", lambda m: _code_point(F.substr(m, F.lit(2))))


def clean_slashes(text: Column, few_breaks: bool = False) -> Column:
    """Removes slashes that a decoding has left: at ends of lines and between words. Real ones between words go as well."""
    text = F.replace(text, F.lit("\\n"), F.lit("\n"))
    if few_breaks:
        text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)/\s*\n", "\n"), r"(?U)/\s*\z", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)(\w+)/(\w+)", "$1$2"), r"(?U)(\d+)/(\d+)", "$1$2")
    lines = F.split(F.regexp_replace(text, " +", " "), "\n")
    return F.array_join(F.transform(lines, strip), "\n")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), 0)


def fuzzy(text: Column, ignored: Sequence[str] = FILLER_WORDS) -> Column:
    """Lower case, without punctuation (nothing in its place) and filler words."""
    plain = collapse(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""))
    return F.array_join(F.filter(F.split(plain, " "), lambda w: ~w.isin(*ignored)), " ")


def meaning(text: Column, ignored: Sequence[str] = FILLER_WORDS + STOP_WORDS) -> Column:
    """Lower case, a space for punctuation, without stop words and words of one or two characters."""
    plain = collapse(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "))
    return F.array_join(F.filter(F.split(plain, " "), lambda w: (F.length(w) > 2) & ~w.isin(*ignored)), " ")


def data_only(text: Column) -> Column:
    """The text in lower case if it holds a number or names data, else nothing."""
    lower = F.lower(text)
    ends: dict[str, list[str]] = {}
    for word in KEY_INDICATORS:
        ends.setdefault(word[0], []).append(re.escape(word[1:]))
    named = lower.rlike("|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in ends.items()))  # one pass, few tries at a place
    return F.when(text.rlike("[0-9]") | named, strip(lower)).otherwise("")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets: both empty 1, one empty 0."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def characters(text: Column) -> Column:
    """The distinct characters of a text in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), "")), lambda c: c != "")


def character_similarity(a: Column, b: Column) -> Column:
    return jaccard(characters(a), characters(b))


def key_terms(text: Column) -> Column:
    """The distinct words of meaning() with over three characters."""
    words_ = F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w]+", " "), " ")
    return F.array_distinct(F.filter(words_, lambda w: (F.length(w) > 3) & ~w.isin(*FILLER_WORDS, *STOP_WORDS)))


def term_similarity(a: Column, b: Column) -> Column:
    empty = lambda x: F.length(x) == 0
    return F.when(empty(a) & empty(b), 1.0).when(empty(a) | empty(b), 0.0).otherwise(jaccard(key_terms(a), key_terms(b)))


def matched_terms(text: Column, terms: Sequence[str]) -> Column:
    """Those terms that stand anywhere in the text, case ignored."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t))


def long_lines(text: Column, limit: int) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.length(strip(line)) > limit)


def markdown_cell(value: Column) -> Column:
    return F.coalesce(strip(value.cast("string")), F.lit(""))
