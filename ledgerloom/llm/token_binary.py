"""Token ids in a packed binary file format, with random access.

A shard holds whole documents in ascending doc_id order. It is one binary value, and a row of a Parquet table, so that
Spark's own writers commit it and any store that Spark reads can hold it:

    header   magic "LLTB", version, bits per id, documents, ids in a block, ids in all
    table    doc_id, a byte that says whether the doc_id is there, first id of each document and the end
    blocks   first byte of each block of ids in the payload, and the end
    payload  blocks of ids, each packed in the fewest bits that hold the vocabulary, lowest bit first

Blocks hold a multiple of 8 ids, so each starts at a whole byte and any run of ids is read from its blocks alone.

The string of an added token in a text becomes its id, as the library does it. Null texts are empty documents, of the end id only.
A document longer than a shard is a shard of its own. Repeated rows each keep their place; among rows of one doc_id
the order is that of their texts. Rows without doc_id come first. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, common

HEADER = struct.Struct("<4sBBHIIQ")
MAGIC, VERSION = b"LLTB", 1
BLOCK_IDS, SHARD_IDS = 1 << 14, 1 << 20
#: Characters of a text by which ranges of documents are told apart.
START_CHARS = 64
SHARDS = "part int, seq int, first_doc long, docs int, ids long, shard binary"


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = ((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(each, bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def build_shard(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, block: int = BLOCK_IDS) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    packed = [pack(flat[i : i + block], bits) for i in range(0, len(flat), block)]
    return b"".join(
        [
            HEADER.pack(MAGIC, VERSION, bits, 0, len(ids), block, len(flat)),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
            np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype("<u8").tobytes(),
            np.concatenate(([0], np.cumsum([len(x) for x in packed]))).astype("<u8").tobytes(),
            *packed,
        ]
    )


class Shard:
    """Reads a shard: its documents, or any run of its ids."""

    def __init__(self, data: bytes):
        self.data = data
        magic, version, self.bits, _, docs, self.block, self.ids = HEADER.unpack_from(data)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a shard of token ids")
        at = HEADER.size
        own = np.frombuffer(data, "<i8", docs, at)
        there = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [int(d) if t else None for d, t in zip(own, there, strict=True)]
        at += 9 * docs
        self.starts = np.frombuffer(data, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        blocks = -(-self.ids // self.block)
        self.blocks = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = at + 8 * (blocks + 1)

    def read(self, start: int, stop: int) -> np.ndarray:
        if not 0 <= start <= stop <= self.ids:
            raise IndexError(f"{start}:{stop} of {self.ids} ids")
        if start == stop:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        got = self.data[self.payload + self.blocks[a] : self.payload + self.blocks[b]]
        n = min(b * self.block, self.ids) - a * self.block
        return unpack(got, n, self.bits)[start - a * self.block : stop - a * self.block]

    def whole(self, step: int = 16) -> np.ndarray:
        """All ids, unpacked some blocks at a time."""
        step *= self.block
        return np.concatenate([np.zeros(0, np.uint32), *(self.read(a, min(a + step, self.ids)) for a in range(0, self.ids, step))])

    def document(self, no: int) -> np.ndarray:
        return self.read(int(self.starts[no]), int(self.starts[no + 1]))


def write_shards(docs: DataFrame, path: str, tokenizer_file: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encodes doc_id and text, ends each document with end_id and writes the shards."""

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder_from_file(tokenizer_file)
        bits, end = bits_for(encoder.vocabulary), np.array([end_id], np.uint32)
        part, seq, total = TaskContext.get().partitionId(), 0, 0
        held_docs: list[int | None] = []
        held: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (held_docs[0], pa.int64()), (len(held), pa.int32()), (total, pa.int64()), (build_shard(held_docs, held, bits), pa.binary()))],
                names=["part", "seq", "first_doc", "docs", "ids", "shard"],
            )

        for batch in rows:
            doc_ids = batch.column("doc_id").to_pylist()
            for start, texts in bpe.batches(batch.column("text").to_pylist(), 1 << 20):
                flat, at = encoder.encode(texts)
                for i in range(len(texts)):
                    ids = np.concatenate([flat[at[i] : at[i + 1]], end])
                    if held and total + len(ids) > shard_ids:
                        yield shard()
                        seq, total, held_docs, held = seq + 1, 0, [], []
                    held_docs.append(doc_ids[start + i])
                    held.append(ids)
                    total += len(ids)
        if held:
            yield shard()

    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The start of the text parts rows of one doc_id, or of none, into several ranges.
    ordered = ordered.repartitionByRange(common.partitions(spark), "doc_id", F.left("text", F.lit(START_CHARS))).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SHARDS).write.option("compression", "zstd").parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the shards alone."""
    shards = spark.read.parquet(path)

    def unpacked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, seq, data in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "shard")), strict=True):
                shard = Shard(data)
                n = len(shard.doc_ids)
                flat = shard.whole().astype("<u4")
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(shard.starts.tolist(), shard.starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1], pa.int64()), pa.array(np.diff(shard.starts), pa.int64()), pa.array(crc, pa.int64())],
                    names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    docs = shards.select("part", "seq", "shard").mapInArrow(unpacked, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # A row for each part only: parts are ranges in ascending order.
    parts = shards.groupBy("part").agg(F.sum("ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before_part"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    places = shards.select("part", "seq", F.coalesce(F.sum("ids").over(within), F.lit(0)).alias("before_shard")).join(parts, "part")
    start = (F.col("before_part") + F.col("before_shard") + F.col("at")).alias("start")
    return docs.join(places, ["part", "seq"]).select("doc_id", start, "n_tokens", "ids_crc32")


def token_binary(docs: DataFrame, tokenizer_file: str, end_id: int, path: str | None = None) -> DataFrame:
    """Writes the shards of docs to path (default: a new folder in the shared one) and reads them back."""
    spark = docs.sparkSession
    common.ship(spark)
    path = path or common.new_path(spark, "token-shards")
    write_shards(docs, path, tokenizer_file, end_id)
    return read_documents(spark, path)
