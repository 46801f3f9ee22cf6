"""Queries over incremental runs: events come as files, some after others, and what comes out is as if they had come at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans.tables import table
from ledgerloom.storage import new_path
from ledgerloom.streaming import incremental
from ledgerloom.streaming.keyed import KeyedTable


def _part(s, d, n: int, of: int):
    return table(s, d, "events").where(F.col("event_id") % of == n)


def _types(df) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def incremental_run(s, d):
    """Two runs over a folder that gets more files in between: totals of what both have written, and the rows that the second one read."""
    source, target, mark = (new_path(s, f"run-{x}") for x in ("source", "target", "mark"))
    schema, read = _types(table(s, d, "events")), 0
    for parts in ((0, 1), (2, 3)):
        for n in parts:
            _part(s, d, n, 4).write.mode("append").parquet(source)
        read = incremental.run_new(s, source, schema, target, mark, lambda rows: rows.withColumn("day", F.to_date("ts")))
    days = s.read.parquet(target).groupBy("day", "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
    return days.withColumn("second_run", F.lit(read).cast("long"))


INCREMENTAL = """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events, round(sum(value), 2) AS total, (SELECT count(*) FROM events WHERE event_id % 4 IN (2, 3)) AS second_run FROM events GROUP BY ALL"""


def keyed_upsert(s, d):
    """The last event of each user and type after three batches, the second of which comes twice."""
    keyed = KeyedTable(s, new_path(s, "keyed"), ["user_id", "event_type"], ["ts", "event_id"], buckets=4, versions=2)
    for n in (0, 1, 1, 2):
        keyed.merge(_part(s, d, n, 3), n)
    return keyed.read().select("user_id", "event_type", "event_id", "ts", "value")


KEYED = """SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""


def run_progress(s, d):
    """Figures that a listener recorded while a stream ran over the events' files, two a batch, summed up."""
    source, target, mark = (new_path(s, f"progress-{x}") for x in ("source", "target", "mark"))
    rows = table(s, d, "events").select("event_id", (F.col("event_type") != "error").alias("success"), F.col("value").alias("seconds"))
    for n in range(6):
        rows.where(F.col("event_id") % 6 == n).coalesce(1).write.mode("append").parquet(source)
    found = incremental.recorded(s, source, _types(rows), target, mark, "success", "seconds", files=2, name=f"progress-{source[-32:]}")
    figures = s.createDataFrame([(f["batch"], f["rows"], f["files"], f["failures"], f["seconds"]) for f in found], "batch long, rows long, files long, failures long, seconds double")
    return figures.agg(F.count("*").alias("records"), F.sum("rows").alias("rows"), F.sum("files").alias("files"), F.sum("failures").alias("failures"), F.round(F.sum("seconds"), 2).alias("seconds"))


PROGRESS = """SELECT 3::BIGINT AS records, count(*) AS rows, count(*) AS files, count_if(event_type IS NULL OR event_type = 'error') AS failures, round(sum(value), 2) AS seconds FROM events"""

QUERIES = {"incremental_run": incremental_run, "keyed_upsert": keyed_upsert, "run_progress": run_progress}
ORACLES = {"incremental_run": INCREMENTAL, "keyed_upsert": KEYED, "run_progress": PROGRESS}
