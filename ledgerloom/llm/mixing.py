"""Mixing sources to target weights by fitting word budgets exactly.

Targets: the budget is shared between sources by weight; a source's share stops at a multiple of its size, and the
excess is shared again by weight between the others until none is above. A target is met by whole passes over the
source and a subset of its documents for what is left. The subset is a subset-sum fit: documents are counted by exact
length, each length gets its proportional number, and bounded knapsacks over ever more lengths and documents of each, in
the end over all, make up the rest.
Which documents of a length are taken is decided by the order of a seeded hash.

Only counts by (source, length) reach a single task, never documents. Reruns give the same rows.

Null texts and texts without words have size 0 and take 0. Null is a source of its own, last in order. Very long texts count
whole. Repeated rows count each; rows that are the same in all that decides stand for one another. A source of size 0 has target 0. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import common

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one (source, length, bucket) that are ranked together, about.
BUCKET_ROWS = 1_000_000


def ranked(rows: DataFrame, column: str, tag: str) -> DataFrame:
    """rows with no, the 0-based rank of column in code point order, null last. Ranges are ranked each by itself."""
    ranged = rows.repartitionByRange(common.partitions(rows.sparkSession), F.asc_nulls_last(column)).withColumn("range", F.spark_partition_id())
    ranged = common.written(ranged, tag)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(F.asc_nulls_last(column)))
    return ranged.withColumn("at", within).join(counts, "range").withColumn("no", F.col("before") + F.col("at") - 1).drop("range", "at", "before")


def targets(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """source, no, source_size, target. sources: source and source_size, a row for each source."""
    each = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("no") % len(weights) + 1).cast("int"))
    table = common.written(ranked(sources, "source", "mix-ranges").withColumn("weight", each), "mix-sources")
    cap = F.col("source_size") * F.lit(float(most))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # a round for each set of sources that stops; the level only rises
        stops = cap <= F.lit(level) * F.col("weight")
        held, left = table.agg(F.sum(F.when(stops, cap)), F.sum(F.when(~stops, F.col("weight")))).first()
        new = (total - (held or 0.0)) / left if left else level
        if not new > level:
            break
        level = new
    return table.select("source", "no", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target"))


def _reversed(bits: int, top: int) -> int:
    """The number with bit top - i for each bit i of bits."""
    size = top // 8 + 1
    mirror = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.uint8)
    flipped = mirror[np.frombuffer(bits.to_bytes(size, "little"), np.uint8)][::-1]
    return int.from_bytes(flipped.tobytes(), "little") >> (8 * size - 1 - top)


def _sums(parts: list[tuple[int, int, int]], top: int) -> int:
    """A bit for each sum up to top that some of the parts make."""
    mask, reach = (1 << (top + 1)) - 1, 1
    for _, _, size in parts:
        reach = (reach | reach << size) & mask
    return reach


def _summing(parts: list[tuple[int, int, int]], goal: int) -> list[tuple[int, int, int]]:
    """Some of the parts (the last of each is its size) that make goal exactly, which some do.

    Both halves' sums tell how much of goal comes from the first; then each half is asked in the same way. So only a few sets of sums are held at
    a time, however many parts there are, for twice the work.
    """
    if not goal or not parts:
        return []
    if len(parts) == 1:
        return parts
    half = len(parts) // 2
    both = _sums(parts[:half], goal) & _reversed(_sums(parts[half:], goal), goal)
    first = (both & -both).bit_length() - 1
    return _summing(parts[:half], first) + _summing(parts[half:], goal - first)


def _near(lengths: np.ndarray, counts: np.ndarray, goal: int, over: bool) -> np.ndarray:
    """How many documents of each length come nearest to goal words; of two as near the larger sum if over, else the smaller."""
    have = int((lengths * counts).sum())
    take = np.array([int(c) * goal // have for c in counts], np.int64)
    rest, carry = goal - int((lengths * take).sum()), 0.0
    order = [int(j) for j in np.argsort(-lengths, kind="stable") if lengths[j]]
    for j in order:  # longest first: each length hands on what it could not take
        carry += lengths[j] * (counts[j] * goal / have - take[j])
        more = int(min(counts[j] - take[j], max(0, carry) // lengths[j], rest // lengths[j]))
        take[j] += more
        carry -= more * lengths[j]
        rest -= more * int(lengths[j])
    for j in order:
        more = int(min(counts[j] - take[j], rest // lengths[j]))
        take[j] += more
        rest -= more * int(lengths[j])

    usable = [j for j in order[::-1] if counts[j] and lengths[j] <= 2 * goal]  # a longer one is farther off than nothing
    step = int(np.gcd.reduce(lengths[usable])) if usable else 0
    below = goal % step if step else 0
    best = min((below, over), (step - below, not over)) if below else (0, False)
    gap, n, each = (rest, over and rest > 0), 8, 1
    # Some documents of some lengths are given back and chosen anew, of ever more until the sum is as near as a multiple of step can be.
    while usable and gap > best:
        pool = usable[:n]
        back = {j: int(min(take[j], each)) for j in pool}
        at = goal - int((lengths * take).sum()) + sum(k * int(lengths[j]) for j, k in back.items())
        limit = at + gap[0]
        mask, reach, parts, used = (1 << (limit + 1)) - 1, 1, [], 0
        for j in pool:
            left, k = int(min(counts[j] - take[j] + back[j], 2 * each, limit // lengths[j])), 1
            while left:
                k = min(k, left)
                parts.append((j, k, k * int(lengths[j])))
                left, k = left - k, 2 * k
        for _, _, size in parts:
            if reach >> at & 1:
                break
            reach, used = (reach | reach << size) & mask, used + 1
        low, high = at - ((reach & ((1 << (at + 1)) - 1)).bit_length() - 1), reach >> at
        up = (high & -high).bit_length() - 1
        found = min([(low, over and low > 0, at - low), *([(up, not over and up > 0, at + up)] if high else [])])
        if found[:2] < gap:
            gap, at = found[:2], found[2]
            for j, k in back.items():
                take[j] -= k
            for j, k, _ in _summing(parts[:used], at):
                take[j] += k
        if n >= len(usable) and each >= counts[usable].max():
            break
        n, each = 2 * n, 2 * each
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length add up to budget words, or as near as any do; of two as near the smaller sum."""
    have = int((lengths * counts).sum())
    if budget <= 0 or not have:
        return np.zeros(len(lengths), np.int64)
    if budget >= have:
        return counts.astype(np.int64)
    if 2 * budget <= have:
        return _near(lengths, counts, budget, False)
    kept = counts - _near(lengths, counts, have - budget, True)  # what is left out is less
    return np.where(lengths > 0, kept, [int(c) * budget // have for c in counts])


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target and copies: how often the mix takes the document; taken is size times copies."""
    return chosen(docs, weights, most, seed).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def chosen(docs: DataFrame, weights: Sequence[float], most: float, seed: int) -> DataFrame:
    """doc_id, sig (hash of text and source), source, size, source_size, target and copies of each row of docs."""
    common.ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text", "source").alias("sig"))
    slim = common.written(slim, "mix-sizes")
    counted = common.written(slim.groupBy("source", "size").agg(F.count("*").alias("docs")), "mix-lengths")
    sources = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    plan = targets(sources, weights, most)
    whole = F.round("target").cast("long")
    times = math.ceil(most)  # a source's share stops at most times its size; a document of it is taken so often, rounded up
    passes = F.when(F.col("source_size") > 0, F.least(F.lit(times), F.floor(whole / F.col("source_size")))).otherwise(0).cast("int")
    plan = plan.withColumn("passes", passes).withColumn("budget", F.when(F.col("passes") < times, whole - F.col("passes") * F.col("source_size")).otherwise(0))
    plan = common.written(plan, "mix-plan").withColumnRenamed("source", "plan_source")

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", kind="stable")
        wanted = fit(rows["size"].to_numpy(), rows["docs"].to_numpy(), int(rows["budget"].iloc[0]))
        return rows[["no", "size"]].assign(wanted=wanted)

    same = F.col("source").eqNullSafe(F.col("plan_source"))
    lengths = counted.join(plan, same).select("no", "size", "docs", "budget")
    wanted = common.written(lengths.groupBy("no").applyInPandas(fitted, "no long, size long, wanted long"), "mix-wanted")

    largest = counted.agg(F.max("docs")).first()[0] or 0
    buckets = max(64, -(-largest // BUCKET_ROWS))
    order: Column = F.xxhash64("doc_id", "sig", F.lit(seed))  # without the text, rows of one doc_id would tie
    placed = slim.join(plan, same).withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(buckets)))
    placed = placed.select("doc_id", "sig", "source", "no", "size", "source_size", "target", "passes", "order", "bucket")
    # Buckets of the hash are taken whole in their order; only in the one where the number runs out are documents ranked.
    sums = placed.groupBy("no", "size", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("no", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = sums.withColumn("before", before).join(wanted.hint("merge"), ["no", "size"]).select("no", "size", "bucket", (F.col("wanted") - F.col("before")).alias("room"))
    rank = F.row_number().over(Window.partitionBy("no", "size", "bucket").orderBy("order", "doc_id", "sig"))
    done = placed.join(shares.hint("merge"), ["no", "size", "bucket"]).withColumn("copies", F.col("passes") + (rank <= F.col("room")).cast("int"))
    return done.select("doc_id", "sig", "source", "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 11) -> DataFrame:
    """The rows of the mix, with docs' columns: a document is there as often as the mix takes it, so not at all where it takes none.

    Rows of one doc_id, text and source stand for one another: the mix takes them as often as all of them together.
    """
    taken = chosen(docs, weights, most, seed).where("copies > 0").groupBy("doc_id", "sig").agg(F.sum("copies").cast("int").alias("_mix_copies"))
    taken = common.written(taken.select(F.col("doc_id").alias("_mix_doc"), F.col("sig").alias("_mix_sig"), "_mix_copies"), "mix-taken")
    own = docs.withColumn("_mix_own", F.xxhash64("text", "source"))
    repeats = own.groupBy("doc_id", "_mix_own").count().where("count > 1").select(F.col("doc_id").alias("_mix_twice"), F.col("_mix_own").alias("_mix_twice_sig"))
    repeats = common.lookup(repeats, "mix-twice")
    if not repeats.isEmpty():  # only rows that are there several times are brought together
        again = (F.col("_mix_own") == F.col("_mix_twice_sig")) & F.col("doc_id").eqNullSafe(F.col("_mix_twice"))
        first = F.row_number().over(Window.partitionBy("doc_id", "_mix_own").orderBy(F.to_json(F.struct(*docs.columns))))
        once = own.join(repeats, again, "left_semi").withColumn("_mix_no", first).where("_mix_no = 1").drop("_mix_no")
        own = own.join(repeats, again, "left_anti").unionByName(once)
    same = (F.col("_mix_own") == F.col("_mix_sig")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_mix_doc"))
    taken = F.broadcast(taken) if common.small_enough(taken) else taken
    copies = F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))).alias("_mix_copy")
    return own.join(taken, same).select(*docs.columns, copies).drop("_mix_copy")
