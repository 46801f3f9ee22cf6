"""How filters of documents interact: what each removes alone, together and in every order.

A document's failures are bits of a mask, one a filter, independent of order. Documents are counted by part and mask, so all
that follows works on at most 2 ** filters cells a part, however large a part is. The cells are then unpivoted against the
steps of all orders: a row for each cell, order and step. A running bit-or over the earlier steps of an order says which
failures came before, so conditional sums give what a step keeps, removes and finds removed already; a window over a filter's
steps in all orders gives its Shapley total.

The filters of text_filters are built-in functions of the text. The filter of copies compares with the smallest doc_id that
has the same text (its SHA-256), found by one pre-aggregated group a text and joined back as a table, in which Spark can
split a text that very many documents share.

Null texts are empty. Rows without doc_id come after all others: they are copies of any row with a doc_id and the same text, not of
one another. Repeated rows of one doc_id count each and are no copies of one another. Rows without part belong to the part with the
empty name. A document is good, or toxic, if any of its labels says so; rows without doc_id have no label. Very long texts
are taken whole. An empty table has no parts and gives no rows. Columns other than the ones that are named are ignored.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import common

SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """A to D: whether a text has too few words, too few different words, too many capitals, or an odd character."""
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, part: str, copies: str = "E") -> tuple[DataFrame, list[str]]:
    """doc_id, part, mask, good and toxic of each row of docs, and the filters in the order of the mask's bits; the filter of copies is the last."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = text_filters(F.col("_text"), F.col("_words"))
    bits = [F.when(failed, F.lit(1 << i)).otherwise(0) for i, failed in enumerate(named.values())]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("_text")).withColumn("_words", words_of(F.col("_text")))
    slim = common.written(slim.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("sha"), sum(bits[1:], bits[0]).alias("mask")), "audit-masks")
    shared = slim.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1 and first is not null").select("sha", "first")
    copied = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    judged = slim.join(common.lookup(shared, "audit-shared"), "sha", "left")
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    judged = judged.join(common.lookup(told.where("doc_id is not null and (good or toxic)"), "audit-labels"), "doc_id", "left")
    mask = F.col("mask") + F.when(copied, F.lit(1 << len(named))).otherwise(0)
    flags = (F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))
    return judged.select("doc_id", "part", mask.alias("mask"), *flags), [*named, copies]


def cells(judged: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: documents of each part by the set of filters that they fail."""
    return judged.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def audit(counted: DataFrame, filters: list[str]) -> DataFrame:
    """part, filter_order, step (from 1), filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley for all orders of the filters.

    counted: cells() or a table like it. kept: failing none up to this step; removed: failing this step's filter first; redundant:
    failing it after an earlier one; unique_fails: failing it alone; shapley: what the filter removes, over all orders.
    """
    bit = {f: 1 << i for i, f in enumerate(filters)}
    told = [{"filter_order": "".join(order), "step": i, "filter": f, "bit": bit[f]} for order in permutations(filters) for i, f in enumerate(order, 1)]
    steps = F.from_json(F.lit(json.dumps(told)), "array<struct<filter_order:string,step:int,filter:string,bit:int>>")  # one literal, folded when the query is planned
    unpivoted = counted.select("part", "mask", "n", "good", "toxic", F.inline(steps)).repartition(common.partitions(counted.sparkSession), "part", "filter_order")
    earlier = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.bit_or(F.col("mask").bitwiseAND(F.col("bit"))).over(earlier), F.lit(0))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("before") != 0
    total = lambda c, where: F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0)).cast("long")
    found = (
        unpivoted.withColumn("before", before)
        .groupBy("part", "filter_order", "step", "filter")
        .agg(
            total("n", ~fails & ~gone).alias("kept"),
            total("n", fails & ~gone).alias("removed"),
            total("n", fails & gone).alias("redundant"),
            total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
            total("good", fails & ~gone).alias("good_lost"),
            total("toxic", fails & ~gone).alias("toxic_lost"),
        )
    )
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audited(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """The audit of text_filters and of copies over docs (doc_id, text, part) with labels (doc_id, quality, toxic)."""
    common.ship(docs.sparkSession)
    judged, filters = masks(docs, labels, part)
    # One row a part and set of failures: what is unpivoted and sorted from here on no longer grows with the documents.
    return audit(common.written(cells(judged), "audit-cells"), filters)
