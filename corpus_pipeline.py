"""The corpus pipeline: documents in, token ids out. Each stage is one operator of ledgerloom.llm.

Null and empty texts, and those without letters, have no language and go in the first stage. Rows without doc_id or source are
documents like others, last in order. Repeated rows stay until the n-gram Jaccard join, which keeps one. Very long texts are
handled whole by every stage; ties are the operators'. An empty table passes through all stages. Other columns of documents are kept
up to the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, common, language_id, mixing, ngram_join, substring_dedup

#: What the language operator adds.
LANGUAGE_COLUMNS = ("held_out", "lang_pred", "score", "languages")
#: A document whose main language has a smaller share than this is rejected.
LEAST_SHARE = 0.5
#: Words of a shingle and similarity in per cent from which documents count as near copies.
SHINGLE, NEAR = 5, 80
#: Weights of the sources, in order of their names, repeating, and how often a document may be taken at most.
WEIGHTS, MOST = (5, 2, 1), 3.0
#: Segments whose ids a worker of the last stage keeps, about: it stands beside a heap that the joins before have filled.
SEGMENTS = 200_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are written in one of the learned languages; those without letters or without a main language go."""
    own = {c: f"_own_{c}" for c in docs.columns if c in LANGUAGE_COLUMNS}  # columns of documents that are named as the operator's
    found = language_id.identified(docs.withColumnsRenamed(own))
    kept = found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.representatives(docs, k=SHINGLE, per_cent=NEAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that another document keeps; n_chars is that of the text that is left."""
    found = substring_dedup.deduplicated(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document that it takes n times is there n times."""
    return mixing.mixed(docs, weights=WEIGHTS, most=MOST)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and a check that they decode to its text."""
    coded = byte_bpe.encode_checked(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=SEGMENTS)
    same = F.col("decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return coded.select("doc_id", "lang", "source", "ids", "n_tokens", same.alias("round_trip"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", weighted),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Models and iteration cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents. Each one's result is written to the shared folder and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
        common.dropped(*before)
        before = [docs]
    return docs
