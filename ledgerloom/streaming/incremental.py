"""Incremental runs: new files only, a keyed log that later rows replace, and figures of a run while it goes."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ledgerloom.streaming.keyed import KeyedTable


def run_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]) -> int:
    """Applies transform to the Parquet files of source that no earlier run has seen and appends to target. Returns the rows of this run."""
    rows = spark.readStream.schema(schema).parquet(source)
    query = transform(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


class Recorder(StreamingQueryListener):
    """Keeps the figures of each batch of the streams of one name while they run: batch, rows, seconds that it took and what the batch observed as figures."""

    def __init__(self, name: str):
        self.name, self.runs, self.figures, self.ended = name, set(), [], threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.runs.add(event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.runId in self.runs and p.numInputRows:
            seen = json.loads(p.json).get("observedMetrics", {}).get("figures", {})
            self.figures.append({"batch": p.batchId, "rows": p.numInputRows, "took": p.durationMs.get("triggerExecution", 0) / 1000} | seen)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId in self.runs:
            self.ended.set()


def recorded(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, success: str, seconds: str, files: int = 100, name: str = "recorded", wait: float = 60) -> list[dict]:
    """Copies new files of source to target, so many files a batch, and returns the figures of each batch: rows, failures and seconds. A listener gets them while the stream runs."""
    recorder = Recorder(name)
    spark.streams.addListener(recorder)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        figures = (F.count("*").alias("files"), F.count_if(~F.coalesce(F.col(success), F.lit(False))).alias("failures"), F.sum(seconds).alias("seconds"))
        query = rows.observe("figures", *figures).writeStream.queryName(name).format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if not recorder.ended.wait(wait):  # events come after the stream itself has ended
            raise TimeoutError("the listener got no word of the end of the stream")
        return recorder.figures
    finally:
        spark.streams.removeListener(recorder)


def watched(rows: DataFrame, success: str, seconds: str) -> tuple[DataFrame, Observation]:
    """rows as they are, and an observation of how many came through and failed and their seconds: filled by the first action on rows, without a pass of its own."""
    seen = Observation()
    figures = (F.count("*").alias("files"), F.count_if(~F.col(success)).alias("failures"), F.sum(seconds).alias("seconds"))
    return rows.observe(seen, *figures), seen


def upsert_log(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: Sequence[str], at: str) -> None:
    """Keeps in target the latest row of each key of all files of source, new ones only. Batches that are run again after a failure change nothing."""
    table = KeyedTable(spark, target, keys, [at])
    rows = spark.readStream.schema(schema).parquet(source)
    query = rows.writeStream.foreachBatch(lambda batch, batch_id: table.merge(batch, batch_id) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, target: str, keys: Sequence[str], at: str) -> DataFrame:
    """The latest row of each key."""
    return KeyedTable(spark, target, keys, [at]).read()


def windowed_progress(events: DataFrame, at: str, lateness: str, width: str) -> DataFrame:
    """Runs, failures and seconds by time window, for batch and stream alike; a stream forgets windows older than the lateness."""
    timed = events.withWatermark(at, lateness) if events.isStreaming else events
    return timed.groupBy(F.window(at, width).alias("w")).agg(F.count("*").alias("runs"), F.count_if(~F.col("success")).alias("failures"), F.sum("seconds").alias("seconds")).select(F.col("w.start").alias("start"), "runs", "failures", "seconds")
