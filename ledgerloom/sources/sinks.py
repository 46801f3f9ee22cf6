"""Writers. Spark's commit protocol takes the place of locks, temporary files and retries."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import NumericType, StructType

from ledgerloom.operators.dedupe import keep
from ledgerloom.operators.ranges import placed
from ledgerloom.storage import on_disk


def described(rows: DataFrame, descriptions: Mapping[str, str]) -> DataFrame:
    """rows with a comment on each described column, kept in the schema that Parquet stores."""
    return rows.select(*(F.col(c).alias(c, metadata={"comment": descriptions[c]}) if c in descriptions else F.col(c) for c in rows.columns))


def write_table(rows: DataFrame, path: str, descriptions: Mapping[str, str] | None = None, partition_by: Sequence[str] = ()) -> None:
    writer = described(rows, descriptions or {}).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_partitions(rows: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Puts rows in place of those partitions of a table that they have rows for; the others stay.

    Tasks write to a staging folder and partitions change only when all have succeeded: after a failure the table is as before.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)


def report_lines(sections: Sequence[tuple[str, DataFrame, str, Sequence[str], Sequence[str]]]) -> DataFrame:
    """section, no and line of a text report. Each section: title, rows, a printf form of a line, the columns that fill it, and those that order the rows.

    A section is its title, a rule as long as that, a line for each row and an empty one, or "(none)". A row with a null has its values side by side, "-" for null.
    """
    out = None
    for at, (title, rows, form, columns, order) in enumerate(sections):
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        values = [F.col(c) if isinstance(kinds[c], NumericType) else F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]
        line = F.coalesce(F.when(reduce(and_, (v.isNotNull() for v in values), F.lit(True)), F.format_string(form, *values)), F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns)))
        body = placed(rows, list(order), "_no").select((F.col("_no") + 2).cast("long").alias("no"), line.alias("line"))
        body = body.unionByName(body.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, F.lit(2)).otherwise(F.col("n") + 2).cast("long").alias("no"), F.when(F.col("n") == 0, F.lit("(none)")).otherwise("").alias("line")))
        head = rows.sparkSession.createDataFrame([(0, title), (1, "-" * len(title))], "no long, line string")
        section = head.unionByName(body).select(F.lit(at).alias("section"), "no", "line")
        out = section if out is None else out.unionByName(section)
    if out is None:
        raise ValueError("a report has at least one section")
    return out


def write_report(lines: DataFrame, path: str) -> None:
    """The lines of a report as text, in order from one file to the next."""
    write_lines(lines.orderBy("section", "no"), path)


def write_lines(rows: DataFrame, path: str, line: str = "line") -> None:
    """A report, one text line for each row."""
    rows.select(line).write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_summary(row: DataFrame, path: str) -> None:
    """The one row of a summary as JSON, in place of the one before."""
    row.limit(1).coalesce(1).write.mode("overwrite").json(path)


def checked_json(rows: DataFrame, column: str) -> DataFrame:
    """Adds is_valid and pretty: valid JSON in a normal form, other text as it is."""
    value = F.try_parse_json(column)
    return rows.withColumn("is_valid", value.isNotNull()).withColumn("pretty", F.coalesce(F.to_json(value), F.col(column)))


def upserted(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """existing with new rows in place of those with the same key; of several new ones the last by all columns."""
    latest = keep(new, keys, [F.desc(c) for c in new.columns if c not in keys])
    return existing.join(latest.select(*keys), list(keys), "left_anti").unionByName(latest, allowMissingColumns=True)


def failures(rows: DataFrame, ok: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Rows that came through, and the others with the reason, for a log of their own."""
    good = F.coalesce(F.col(ok), F.lit(False))
    return rows.where(good), rows.where(~good).select("*", F.coalesce(reason, F.lit("unknown")).alias("failure"))


#: Folders that a task writes into, so that also a few tasks make enough for Spark to list them in tasks.
FOLDERS = 16


def one_file_each(rows: DataFrame, path: str, key: str, text: str) -> None:
    """Each row's text as a file of its own, one line, in the numbered folder of its key. The folder must be new.

    Those lie in folders that one task each fills, so a commit moves whole folders and no single files, and tasks share their listing.
    On a local disk Hadoop without its native library starts a process for each file, which takes far longer than the file, so there Python writes them.
    """
    part = F.spark_partition_id() * FOLDERS + F.pmod(F.xxhash64(key), F.lit(FOLDERS)).cast("int")
    own = rows.select(part.alias("part"), F.col(key).cast("long").alias("agreement"), F.col(text).alias("text"))
    disk = on_disk(rows.sparkSession, path)
    if disk is None:
        own.write.option("maxRecordsPerFile", 1).partitionBy("part", "agreement").text(path)
        return
    os.makedirs(disk)
    rows.sparkSession.dataSource.register(OneFileEach)
    own.select("part", "agreement", F.col("text").cast("binary").alias("text")).write.format(OneFileEach.name()).mode("append").save(disk)


@dataclass
class _Filled(WriterCommitMessage):
    """The folders that a task has filled, below the one that it wrote in."""

    own: str
    parts: list[str]


class _FilesWriter(DataSourceArrowWriter):
    """Tasks write in folders of their own attempt; what those that Spark commits have filled is then moved into place."""

    def __init__(self, root: str):
        self.root, self.draft = root, f"{root}/_temporary"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Filled:
        own = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        folders: dict[tuple, str] = {}
        n = 0
        for batch in iterator:
            for part, key, text in zip(*(batch.column(c).to_pylist() for c in ("part", "agreement", "text")), strict=True):
                if (folder := folders.get((part, key))) is None:
                    name = "__HIVE_DEFAULT_PARTITION__" if key is None else key  # as Spark names it
                    folder = folders[part, key] = f"{self.draft}/{own}/part={part}/agreement={name}"
                    os.makedirs(folder)
                with open(f"{folder}/part-{own}.c{n:03d}.txt", "xb") as out:
                    out.write(text or b"")
                    out.write(b"\n")
                n += 1
        return _Filled(own, sorted({f"part={part}" for part, _ in folders}))

    def commit(self, messages: list[_Filled | None]) -> None:
        for filled in messages:
            for part in filled.parts if filled else ():
                os.rename(f"{self.draft}/{filled.own}/{part}", f"{self.root}/{part}")
        shutil.rmtree(self.draft, ignore_errors=True)

    def abort(self, messages: list[_Filled | None]) -> None:
        shutil.rmtree(self.draft, ignore_errors=True)


class OneFileEach(DataSource):
    """Writes one_file_each's rows: part, agreement and text, as bytes."""

    @classmethod
    def name(cls) -> str:
        return "one_file_each"

    def writer(self, schema: StructType, overwrite: bool) -> _FilesWriter:
        return _FilesWriter(self.options["path"])
