"""Harmonic packing of tokenized documents into sequences of a fixed capacity.

A document is cut from its start into pieces whose lengths are reciprocal shares of the capacity: whole capacities, then at
most one piece each of a half, a quarter and so on down to SMALLEST, then a tail below SMALLEST. Each length is a class of its own.
A sequence of a class holds a fixed count of pieces, capacity // length, so a piece's sequence and place follow from its rank in
the class alone. Workers number the pieces of each class by themselves; the counts by worker and class, summed up, give every
worker its first rank, and pieces are never moved or compared. Full sequences of the reciprocal classes have no padding,
those of a tail class less than the tail's length.

The pieces that fill no sequence of their class are fewer than capacity // length for each length, whatever the input: about 4,200 at a capacity of
1,024. They are laid one behind another and cut at whole capacities, the rest at powers of two, so that no sequence of theirs is padded.

Null texts are empty: such a document has its end id only. Every row is a document of its own, repeated ones and those without doc_id too.
Very long texts are encoded in pieces and cut as others. An empty table gives an empty table. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, common

CAPACITY = 1024
#: The shortest reciprocal share that is cut; what is shorter stays whole. Its square is at most the capacity, so no two tails have the same count.
SMALLEST = 32
#: Characters that a worker encodes at once.
BATCH_CHARS = 1 << 20
PIECES = "doc_id long, start long, length int, ids binary, doc_tokens long, part int, no long"


def cut_lengths(lengths: np.ndarray, capacity: int = CAPACITY, smallest: int = SMALLEST) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of all pieces of documents of these lengths, in order, and how many each document has."""
    shares = [capacity >> i for i in range(1, capacity.bit_length()) if capacity >> i >= smallest]
    size, count, left = [np.full(len(lengths), capacity)], [lengths // capacity], lengths % capacity
    for share in shares:
        size.append(np.full(len(lengths), share))
        count.append(left // share)
        left = left % share
    size.append(left)
    count.append((left > 0).astype(np.int64))
    counts = np.stack(count, 1).astype(np.int64)
    return np.repeat(np.stack(size, 1).ravel(), counts.ravel()).astype(np.int64), counts.sum(1)


class Ranks:
    """Ranks of pieces within their class, in order of arrival."""

    def __init__(self, capacity: int):
        self.seen = np.zeros(capacity + 1, np.int64)

    def of(self, lengths: np.ndarray) -> np.ndarray:
        order = np.argsort(lengths, kind="stable")
        counts = np.bincount(lengths, minlength=len(self.seen))
        within = np.arange(len(lengths)) - np.repeat(np.cumsum(counts) - counts, counts)
        out = np.empty(len(lengths), np.int64)
        out[order] = within + self.seen[lengths[order]]
        self.seen += counts
        return out


def cut(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> DataFrame:
    """The pieces of all documents with their ids (little-endian unsigned 32-bit integers), the worker's number and the rank in the class there."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ranks, part = bpe.encoder_from_file(tokenizer_file), Ranks(capacity), TaskContext.get().partitionId()
        for batch in rows:
            doc_ids = batch.column("doc_id")
            for first, texts in bpe.batches(batch.column("text").to_pylist(), BATCH_CHARS):
                flat, at = encoder.encode(texts)
                ids = np.insert(flat, at[1:], end_id).astype("<u4")
                tokens = np.diff(at) + 1
                lengths, pieces = cut_lengths(tokens, capacity, smallest)
                ends = np.cumsum(lengths)
                owner = np.repeat(np.arange(len(texts)), pieces)
                start = ends - lengths - (np.cumsum(tokens) - tokens)[owner]
                edges = np.concatenate(([0], ends)) * 4
                data = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(ids)])
                rank = ranks.of(lengths)
                for a in range(0, len(lengths), 1 << 16):  # a very long document has many pieces
                    b = slice(a, a + (1 << 16))
                    columns = [doc_ids.take(pa.array(first + owner[b])), pa.array(start[b]), pa.array(lengths[b], pa.int32()), data[b].cast(pa.binary()), pa.array(tokens[owner[b]]), pa.array(np.full(len(lengths[b]), part), pa.int32()), pa.array(rank[b])]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids", "doc_tokens", "part", "no"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, PIECES)


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Gives each piece (as cut() makes them, written) its sequence_id, from 0 without gaps, and its offset there. Pieces that fill no sequence may be cut again."""
    spark = pieces.sparkSession
    each = (F.lit(capacity) / F.col("length")).cast("long")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = common.written(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("length"))), "pack-counts")
    # One row a class: at most SMALLEST lengths of tails and the reciprocal shares.
    classes = counts.groupBy("length").agg(F.max("total").alias("total")).withColumn("sequences", F.floor(F.col("total") / each))
    classes = common.written(classes.withColumn("base", F.coalesce(F.sum("sequences").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "pack-classes")
    full = classes.agg(F.coalesce(F.sum("sequences"), F.lit(0))).first()[0]
    first_ranks = counts.select("part", "length", "before")
    first_ranks = F.broadcast(first_ranks) if common.small_enough(counts) else first_ranks  # a row a worker and class
    ranked = pieces.join(first_ranks, ["part", "length"]).join(F.broadcast(classes), "length").withColumn("rank", F.col("before") + F.col("no"))
    own = F.col("rank") < F.col("sequences") * each
    whole = ranked.where(own).select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("base") + F.floor(F.col("rank") / each)).alias("sequence_id"), (F.pmod("rank", each) * F.col("length")).cast("int").alias("offset"))

    # Fewer than capacity // length pieces of each length are left over: one behind another in one window.
    left = ranked.where(~own).withColumn("until", F.sum("length").over(Window.orderBy(F.desc("length"), "rank")))
    left = common.written(left.select("doc_id", "start", "length", "ids", "doc_tokens", "until"), "pack-left")
    total = left.agg(F.max("until")).first()[0] or 0
    bounds = [*range(0, total - total % capacity, capacity), *_powers(total - total % capacity, total % capacity)]
    spans = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in enumerate(zip(bounds, [*bounds[1:], total]))))
    if not bounds:
        return whole
    begins = F.col("until") - F.col("length")
    over = left.withColumn("span", F.explode(F.filter(spans, lambda s: (s["a"] < F.col("until")) & (s["b"] > begins))))
    a = F.greatest(F.col("span.a"), begins)
    size = F.least(F.col("span.b"), "until") - a
    skip = a - begins
    rest = over.select("doc_id", (F.col("start") + skip).alias("start"), size.cast("int").alias("length"), F.col("ids").substr((skip * 4 + 1).cast("int"), (size * 4).cast("int")).alias("ids"), "doc_tokens", (F.lit(full) + F.col("span.i")).cast("long").alias("sequence_id"), (a - F.col("span.a")).cast("int").alias("offset"))
    return whole.unionByName(rest)


def _powers(start: int, rest: int) -> list[int]:
    """Where the sequences of the last rest tokens start: largest powers of two first."""
    out = []
    for i in reversed(range(rest.bit_length())):
        if rest >> i & 1:
            out.append(start)
            start += 1 << i
    return out


def packed(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id and offset of each piece. capacity and smallest are powers of two."""
    if capacity & (capacity - 1) or smallest & (smallest - 1) or not 1 <= smallest <= capacity or smallest * smallest > capacity:
        raise ValueError("capacity and smallest must be powers of two, and smallest squared at most capacity")
    common.ship(docs.sparkSession)
    # Ranks are given as rows come, so the pieces are written once and read from there ever after.
    return placed(common.written(cut(docs, tokenizer_file, end_id, capacity, smallest), "pack-pieces"), capacity)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (binary, padded with pad_id to the capacity unless its length is a power of two), n_tokens and the pieces' doc_id, start and offset. At most capacity pieces meet in a row."""
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias("p"), F.sum("length").cast("int").alias("n_tokens"))
    data = F.aggregate("p", F.lit(b""), lambda x, p: F.concat(x, p["ids"]))
    power = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    padding = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), F.when(power, 0).otherwise(F.lit(capacity) - F.col("n_tokens"))))
    return rows.select("sequence_id", F.concat(data, padding).alias("ids"), "n_tokens", F.transform("p", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["offset"].alias("offset"))).alias("pieces"))
