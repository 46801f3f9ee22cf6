"""A table with one row a key, into which batches are merged: the row that comes last in an order replaces the others.

Rows lie in buckets of a hash of their keys. A batch is written as a version of its own; after a few of them, the buckets that they touch are
written anew and take the place of versions and old buckets. What belongs to the table is told by a log of states (storage.StateLog): a
reader takes one state and sees that one, whatever is written meanwhile, until two more states have come. A batch that comes again, after a failure
or by mistake, changes nothing. What a failed batch has left is in no state and is swept later.

Keys may be null. Of rows of a key with the same order the later batch's wins, within a batch the greatest by its other columns. A key with very
many rows is reduced before the shuffle. A bucket is written by one task, so there should be so many that each fits one.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.storage import Folder, StateLog

BATCH, BUCKET = "_batch", "_bucket"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = 16, versions: int = 8):
        self.spark, self.path, self.keys, self.order, self.buckets, self.versions = spark, path.rstrip("/"), list(keys), list(order), buckets, versions
        self.folder, self.log = Folder(spark, path), StateLog(spark, f"{path.rstrip('/')}/states")

    def _newest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in (*self.keys, *self.order, BATCH)]
        best = F.max(F.struct(*(c for c in self.order if c not in self.keys), BATCH, *others)).alias("_best")
        return rows.groupBy(*self.keys).agg(best).select(*self.keys, "_best.*").select(*rows.columns)

    def _write(self, rows: DataFrame, tag: str) -> str:
        name = f"{tag}-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        rows.withColumn(BUCKET, bucket).repartition(self.buckets, BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        return name

    def _rows(self, state: dict, buckets: Sequence[str] | None = None) -> DataFrame:
        """All rows of some buckets (all where None) and of all versions."""
        names = [f"{where}/{b}" for b, where in state["buckets"].items() if buckets is None or b in buckets]
        schema = StructType.fromJson(state["schema"])
        parts = [self.spark.read.schema(schema).parquet(*(f"{self.path}/{n}" for n in names))] if names else []
        parts += [self.spark.read.schema(schema).parquet(f"{self.path}/{v}").select(*schema.names) for v in state["versions"]]
        out = parts[0] if parts else self.spark.createDataFrame([], schema)
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def read(self) -> DataFrame | None:
        """The table as it is now; None before the first batch."""
        _, state = self.log.last()
        return self._newest(self._rows(state)).drop(BATCH) if state else None

    def merge(self, batch: DataFrame, batch_id: int) -> bool:
        """Merges a batch; False if it, or a later one, is in the table already. Batches come in ascending order of their ids."""
        number, state = self.log.last()
        if state and batch_id <= state["batch"]:
            return False
        rows = self._newest(batch.withColumn(BATCH, F.lit(batch_id).cast("long")))
        state = {"batch": batch_id, "schema": rows.schema.jsonValue(), "buckets": state.get("buckets", {}), "versions": [*state.get("versions", []), self._write(rows, f"version-{batch_id}")]}
        if len(state["versions"]) >= self.versions:
            state = self._compacted(state)
        self._sweep(self.log.commit(number + 1, state))
        return True

    def _compacted(self, state: dict) -> dict:
        """The state with its versions merged into the buckets that they touch; the other buckets stay as they are."""
        touched = sorted({b for v in state["versions"] for b in self.folder.names(v) if b.startswith(f"{BUCKET}=")})
        if not touched:
            return state | {"versions": []}
        name = self._write(self._newest(self._rows(state, touched)), f"base-{state['batch']}")
        return state | {"versions": [], "buckets": state["buckets"] | dict.fromkeys(touched, name)}

    def _sweep(self, states: list[dict]) -> None:
        used = {n for s in states for n in (*s["versions"], *s["buckets"].values())}
        for name in self.folder.names():
            if name.startswith(("version-", "base-")) and name not in used:
                self.folder.delete(name)
