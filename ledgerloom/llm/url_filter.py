"""URL filters: rules first, then what the words in a URL say.

Rules name a host, which stands for its subdomains too, and the start of a path; the longest rule that fits decides.
For other URLs, names in the host are split into words by the Viterbi algorithm under unigram counts of the words in the
pages' own text, and multinomial naive Bayes scores the words of host and path. It learns from the URLs that rules decide.

Counts and scores are tables: the pieces of host names are joined with the word counts, and tokens with their odds.
Everything is done for distinct URLs and joined back to the rows, so nothing depends on page_id and repeated rows stay.

A null URL, or one without `://`, has empty host and path, no rule and no words: its verdict is allow. A score of 0, the
tie of both classes, is allow too; of two equally long rules that fit, the later in code order decides, and of two equally likely
splits the one with the shorter last word. Very long URLs and pages are read whole, and names and words may have any length. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common

ALLOW, BLOCK = "allow", "block"
SMOOTHING = 1.0


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as a struct of rule and verdict, or null. rules: (rule, verdict), a list that fits in a query's plan."""
    fits = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        slash = rule.find("/")
        own, start = (rule, "") if slash < 0 else (rule[:slash], rule[slash:])
        good = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        fits = F.when(good, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def word_counts(pages: DataFrame) -> DataFrame:
    """word and n of the text of all pages, without markup."""
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>|&\w+;", " ")
    words = pages.select(F.explode(F.regexp_extract_all(F.lower(plain), F.lit(r"\p{L}+"), 0)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def best_split(name: str, known: dict[str, int], total: int) -> list[str]:
    """The likeliest words that name consists of. An unknown piece costs more with every letter."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    sizes = sorted({len(w) for w in known}, reverse=True)
    letter, rare = math.log(10), -math.log(total)
    begun = (0.0, 0)  # where an unknown piece starts best: its cost grows by the letter, so that does not depend on its end
    for end in range(1, len(name) + 1):
        found = (begun[0] + rare - letter * end, begun[1])
        for size in sizes:
            if size <= end and (n := known.get(name[end - size : end])):
                found = max(found, (best[end - size][0] + math.log(n / total), end - size))
        best.append(found)
        begun = max(begun, (found[0] + letter * end, end))
    out, end = [], len(name)
    while end:
        start = best[end][1]
        out.append(name[start:end])
        end = start
    return out[::-1]


def segment(names: DataFrame, counts: DataFrame) -> DataFrame:
    """name and words. names: distinct names; counts: word and n, written. A name's pieces are of lengths that known words have: no others can be found."""
    total = int(counts.agg(F.sum("n")).first()[0] or 1)
    lengths = F.array(*(F.lit(r.size) for r in counts.select(F.length("word").alias("size")).distinct().orderBy("size").collect()))  # fewer than the square root of twice the text
    at = F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at")
    pieces = names.where("name != ''").select("name", at)
    size = F.explode_outer(F.filter(lengths.cast("array<int>"), lambda n: n <= F.length("name") - F.col("at") + 1)).alias("size")
    pieces = pieces.select("name", "at", size).select("name", F.expr("substring(name, at, size)").alias("word")).distinct()
    found = pieces.join(counts, "word", "left").groupBy("name").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("known"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            split = [best_split(name, {k["word"]: k["n"] for k in known}, total) for name, known in zip(batch.column("name").to_pylist(), batch.column("known").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(split, pa.list_(pa.string()))], names=["name", "words"])

    return found.mapInArrow(run, "name string, words array<string>")


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict and score, the log odds of block (null where a rule decides)."""
    spark = pages.sparkSession
    common.ship(spark)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    urls = pages.select(url.alias("url")).distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = rule_of(F.col("host"), F.col("path"), rules)
    urls = common.written(urls.withColumn("found", found).select("url", "host", "path", "found.rule", "found.verdict"), "urls")

    # Names are the runs of letters in a host.
    names = urls.select("host").distinct().select("host", F.explode(F.regexp_extract_all("host", F.lit(r"\p{L}+"), 0)).alias("name"))
    counts = common.written(word_counts(pages), "url-word-counts")
    split = segment(names.select("name").distinct(), counts)
    of_host = names.join(split, "name").select("host", F.explode("words").alias("word")).groupBy("host", "word").agg(F.count("*").alias("n"))
    of_host = common.written(of_host.select("host", F.concat(F.lit("host:"), "word").alias("token"), "n"), "url-host-words")
    path_words = F.regexp_extract_all(F.lower("path"), F.lit(r"\p{L}+"), 0)
    of_path = urls.select("url", F.explode(path_words).alias("word")).groupBy("url", "word").agg(F.count("*").alias("n"))
    tokens = urls.select("url", "host").join(of_host, "host").select("url", "token", "n").unionByName(of_path.select("url", F.concat(F.lit("path:"), "word").alias("token"), "n"))
    tokens = common.written(tokens.join(urls.select("url", "verdict"), "url"), "url-tokens")

    # Multinomial naive Bayes: counts of tokens by class, smoothed, from the URLs that rules decide.
    blocked = F.sum(F.when(F.col("verdict") == BLOCK, F.col("n")).otherwise(0)).alias("block")
    allowed = F.sum(F.when(F.col("verdict") == ALLOW, F.col("n")).otherwise(0)).alias("allow")
    by_token = common.written(tokens.groupBy("token").agg(blocked, allowed), "url-odds")
    vocabulary, all_block, all_allow = (int(x or 0) for x in by_token.agg(F.count("*"), F.sum("block"), F.sum("allow")).first())
    n_block, n_allow = (int(x or 0) for x in urls.agg(F.count_if(F.col("verdict") == BLOCK), F.count_if(F.col("verdict") == ALLOW)).first())
    prior = math.log((n_block + SMOOTHING) / (n_allow + SMOOTHING))
    shift = math.log((all_allow + SMOOTHING * vocabulary + 1) / (all_block + SMOOTHING * vocabulary + 1))
    odds = by_token.select("token", (F.log(F.col("block") + SMOOTHING) - F.log(F.col("allow") + SMOOTHING) + F.lit(shift)).alias("odds"))
    scored = tokens.where("verdict is null").join(odds, "token").groupBy("url").agg(F.round(F.sum(F.col("n") * F.col("odds")) + F.lit(prior), 9).alias("score"))
    told = urls.join(scored, "url", "left")
    verdict = F.coalesce("verdict", F.when(F.col("score") > 0, BLOCK).otherwise(ALLOW)).alias("verdict")
    told = told.select("url", "host", "path", "rule", verdict, "score")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url")).join(told, "url").drop("url")
