"""Extraction of documents as a plug-in: a function from texts to topics that runs within tasks.

Recognition and model calls are outside of this library. The default extractor sorts lines by the words in them and needs
no network. Results are worth writing before they are used, since extractors are slow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Words that point to a topic, by topic. The first topic that fits has the line.
TOPIC_WORDS = {
    "wage": ("salary", "wage", "loon", "salaris"),
    "pension": ("pension", "pensioen", "retire"),
    "leave": ("leave", "vacation", "verlof", "vakantie"),
    "termination": ("termination", "notice", "ontslag", "opzeg"),
    "overtime": ("overtime", "overwerk", "shift"),
    "training": ("training", "opleiding"),
    "homeoffice": ("home office", "remote", "thuiswerk"),
}
Extractor = Callable[[str], dict[str, list[str]]] | Callable[[bytes], dict[str, list[str]]]


def by_keywords(text: str) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for line in filter(None, map(str.strip, text.split("\n"))):
        lower = line.lower()
        topic = next((t for t, words in TOPIC_WORDS.items() if any(w in lower for w in words)), "general")
        found.setdefault(topic, []).append(line)
    return found


#: What the table function gives: a row for each line, or one with the error of a document that could not be extracted.
ROWS = StructType().add("topic", StringType()).add("item", IntegerType()).add("line", StringType()).add("error_message", StringType())
FUNCTION = "extracted_topics"


def table_function(extractors: Mapping[str, Extractor]):
    """A table function from a document and the name of an extractor to its lines. The name is checked, and so is the document's type, before a query runs."""

    class Extraction:
        @staticmethod
        def analyze(document: AnalyzeArgument, extractor: AnalyzeArgument = AnalyzeArgument(StringType(), "keywords", False, True)) -> AnalyzeResult:
            if not isinstance(document.dataType, (StringType, BinaryType, NullType)):
                raise ValueError(f"documents are texts or binary, not {document.dataType.simpleString()}")
            if not extractor.isConstantExpression or extractor.value not in extractors:
                raise ValueError(f"no extractor {extractor.value!r}; there are {sorted(extractors)}")
            return AnalyzeResult(ROWS)

        def eval(self, document, extractor: str = "keywords"):
            try:
                found = extractors[extractor]("" if document is None else document)
                rows = [(topic, i, line, None) for topic, lines in found.items() for i, line in enumerate(lines)]
            except Exception as e:  # noqa: BLE001  a plug-in may raise anything
                rows = [(None, None, None, f"{type(e).__name__}: {e}")]
            yield from rows

    return F.udtf(Extraction)


def register(spark: SparkSession, extractors: Mapping[str, Extractor] | None = None, name: str = FUNCTION) -> None:
    """Makes the table function known to SQL: SELECT ... FROM documents, LATERAL extracted_topics(text, 'keywords')."""
    spark.udtf.register(name, table_function({"keywords": by_keywords} | dict(extractors or {})))


def extracted_lines(documents: DataFrame, keys: Sequence[str], text: str, extractor: Extractor = by_keywords) -> DataFrame:
    """keys, topic, item (0-based within the topic), line and error_message: a row for each extracted line, by a lateral join with the table function.

    A document without lines has no row, one that could not be extracted has one with the error.
    """
    rows = table_function({"keywords": extractor})(F.col(text).outer())
    return documents.select(*keys, text).lateralJoin(rows).select(*keys, "topic", "item", "line", "error_message")


def items(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One document to many rows: keys, topic, item (0-based within the topic) and line of all that was extracted."""
    topics = found.select(*keys, F.explode("topics").alias("topic", "lines"))
    return topics.select(*keys, "topic", F.posexplode("lines").alias("item", "line"))


def extracted(documents: DataFrame, keys: Sequence[str], text: str, extractor: Extractor = by_keywords) -> DataFrame:
    """keys, topics (map of topic to lines), success and error_message; one document's failure is its row's error, not the job's.

    text may be a binary column, for an extractor that reads files; null is an empty value of the column's kind.
    """
    rows = documents.select(*keys, text)
    fields = [f for f in rows.schema.fields if f.name in keys]
    empty = b"" if isinstance(rows.schema[text].dataType, BinaryType) else ""
    kind = pa.map_(pa.string(), pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            topics, errors = [], []
            for value in batch.column(text).to_pylist():
                try:
                    topics.append(list(extractor(value or empty).items()))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a plug-in may raise anything
                    topics.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            new = [pa.array(topics, kind), pa.array([e is None for e in errors]), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *new], names=[*keys, "topics", "success", "error_message"])

    return rows.mapInArrow(run, StructType([*fields, *StructType.fromDDL("topics map<string,array<string>>, success boolean, error_message string").fields]))
