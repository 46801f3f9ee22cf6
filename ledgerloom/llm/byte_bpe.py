"""Byte-level BPE encoding and decoding over Arrow batches.

Encoding asks the tokenizers library for the ids of each match of the pattern, under the ranks of a rank file.
Each id stands for some bytes; running sums of their lengths give the bytes of every token, and a running count of the
bytes that start a character turns these into character offsets. A character of several bytes may be split between
tokens: its tokens then all span that character. Decoding looks up the bytes of each id and joins them, so that split
characters are whole again before anything reads them as UTF-8.

Null texts are empty: no ids, no offsets and no bytes. Very long texts are encoded in pieces, with the same ids. All rows,
repeated ones too, and other columns are kept; columns named as an added one are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, common


#: Characters that a worker encodes at once.
BATCH_CHARS = 1 << 20


class Decoder:
    """Bytes of ids, by the reversed byte table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.table = bpe.token_bytes(ranks)
        self.lengths = np.array([len(t) for t in self.table], np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one character of each token in the text whose bytes are data."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        raw = np.frombuffer(data, np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80)  # of each byte, counted from 1
        return (char[starts] - 1, char[ends - 1]) if len(ids) else (starts, ends)

    def split(self, ids: np.ndarray, data: bytes) -> int:
        """Tokens that start within a character."""
        if not len(ids) or len(data) == 0 or data.isascii():
            return 0
        starts = np.cumsum(self.lengths[ids]) - self.lengths[ids]
        return int(((np.frombuffer(data, np.uint8)[starts] & 0xC0) == 0x80).sum())


@common.kept_by_worker
def decoder_for(rank_file: str) -> Decoder:
    return Decoder(bpe.read_ranks(rank_file))


def _mapped(docs: DataFrame, rank_file: str, pattern: str, text: str, fields: list[tuple[str, str, pa.DataType]], compute, keep_text: bool = True, keep: int = bpe.KEEP) -> DataFrame:
    """docs with the fields (name, Spark type, Arrow type) that compute(ids, decoder) gives for each row; workers keep about keep segments."""
    names = [f[0] for f in fields]
    kept = docs.drop(*names)
    passed = [f for f in kept.schema.fields if keep_text or f.name != text]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = bpe.encoder_from_ranks(rank_file, pattern, keep), decoder_for(rank_file)
        for batch in rows:
            whole = batch.column(text)
            for start, part in bpe.batches(whole.to_pylist(), BATCH_CHARS):
                flat, at = encoder.encode(part)
                out = [compute(flat[a:b], decoder) for a, b in zip(at, at[1:])]
                same = [batch.column(f.name).slice(start, len(part)) for f in passed]
                new = [pa.array(list(x), f[2]) for x, f in zip(zip(*out, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*same, *new], names=[*(f.name for f in passed), *names])

    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    schema = StructType([*passed, *(StructField(n, _parse_datatype_string(t)) for n, t, _ in fields)])
    return common.mapped(kept, run, schema, keeps=True)


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ids, the first and last-plus-one character of each token and the number of tokens that start within a character."""

    def compute(ids: np.ndarray, decoder: Decoder):
        data = decoder.decode(ids)
        starts, ends = decoder.offsets(ids, data)
        return ids.astype(np.int32), starts.astype(np.int32), ends.astype(np.int32), decoder.split(ids, data)

    ints = pa.list_(pa.int32())
    fields = [("ids", "array<int>", ints), ("char_starts", "array<int>", ints), ("char_ends", "array<int>", ints), ("split_tokens", "int", pa.int32())]
    common.ship(docs.sparkSession)
    return _mapped(docs, rank_file, pattern, text, fields, compute)


def decode(docs: DataFrame, rank_file: str, ids: str = "ids") -> DataFrame:
    """Adds decoded, the bytes of the ids, and decoded_text, the same as text; bytes that are no UTF-8 become U+FFFD there. Null ids decode to nothing."""
    common.ship(docs.sparkSession)
    kept = docs.drop("decoded", "decoded_text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoder_for(rank_file)
        for batch in rows:
            raw = [decoder.decode(np.asarray(x or [], np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(raw, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in raw], pa.string())], names=[*batch.schema.names, "decoded", "decoded_text"]
            )

    from pyspark.sql.types import BinaryType, StringType, StructType

    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add("decoded", BinaryType()).add("decoded_text", StringType()))


def encode_checked(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: int = bpe.KEEP) -> DataFrame:
    """Adds ids, n_tokens and decoded_sha256, the hash of the bytes that the ids decode to; one worker encodes and decodes a row."""

    def compute(ids: np.ndarray, decoder: Decoder):
        return ids.astype(np.int32), len(ids), hashlib.sha256(decoder.decode(ids)).hexdigest()

    fields = [("ids", "array<int>", pa.list_(pa.int32())), ("n_tokens", "long", pa.int64()), ("decoded_sha256", "string", pa.string())]
    common.ship(docs.sparkSession)
    return _mapped(docs, rank_file, pattern, text, fields, compute, keep=keep)


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Encodes and decodes each text and returns digests instead of the lists.

    offsets_crc32 is the checksum of all tokens' first and then all tokens' last-plus-one characters, as little-endian signed 32-bit integers.
    """

    def compute(ids: np.ndarray, decoder: Decoder):
        data = decoder.decode(ids)
        shown = " ".join(map(str, ids.tolist())).encode()
        starts, ends = (x.astype("<i4").tobytes() for x in decoder.offsets(ids, data))
        return len(ids), hashlib.sha256(shown).hexdigest(), hashlib.sha256(data).hexdigest(), decoder.split(ids, data), zlib.crc32(ends, zlib.crc32(starts))

    fields = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string()), ("split_tokens", "long", pa.int64()), ("offsets_crc32", "long", pa.int64())]
    common.ship(docs.sparkSession)
    return _mapped(docs.select("doc_id", F.col("text").cast("string").alias("text")), rank_file, pattern, "text", fields, compute, keep_text=False)
