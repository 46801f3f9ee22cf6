"""What the operators share: the shared folder, written tables, memory of workers and shipping this package to executors.

Written tables hold nulls, empty and very long texts, repeated rows and columns of any name as they are; an empty table is written as one.
Nothing here joins or orders rows, so names cannot clash and there are no ties; two columns of one name are an error, as for any table.
"""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, unless the session has numbers of its own: long documents make the usual 10,000 rows heavy.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000
BYTES_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20
#: MB of a written table on disk that may be broadcast.
BROADCAST_MB = 8
PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and the master is local, as in tests, one of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _checkpoint_dir(spark)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _checkpoint_dir(spark: SparkSession) -> str | None:
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get() if found.isDefined() else None


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, partition_by: list[str] | None = None) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _folder(table: DataFrame):
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_at)
    return path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()), path


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables. What has been computed from them must be written by then."""
    for table in tables:
        fs, path = _folder(table)
        fs.delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_enough(table: DataFrame, mb: float = BROADCAST_MB) -> bool:
    """Whether a written table may be broadcast: its files have at most so many MB."""
    fs, path = _folder(table)
    return fs.getContentSummary(path).getLength() <= mb * 2**20


def lookup(df: DataFrame, tag: str, mb: float = BROADCAST_MB) -> DataFrame:
    """df, written, to be joined to a larger table: broadcast if its files are small, else both sides are shuffled, where Spark can split a hot key."""
    table = written(df, tag)
    if not small_enough(table, mb):
        return table
    out = F.broadcast(table)
    out._written_at = table._written_at
    return out


_kept: list = []


def kept_by_worker(make):
    """make, whose results a worker process keeps for the tasks that follow, until one of another operator begins."""
    cached = functools.lru_cache(maxsize=4)(make)
    _kept.append(cached)
    return cached


def let_go() -> None:
    """Drops what kept_by_worker keeps."""
    for cached in _kept:
        cached.cache_clear()


def returned() -> None:
    """Gives this process's free memory back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def mapped(df: DataFrame, run, schema, keeps: bool = False) -> DataFrame:
    """df.mapInArrow(run, schema), by tasks that leave no free memory in their worker, which stands beside the joins that follow.

    Workers serve one operator after another: what others keep goes first, unless this one keeps it too.
    """

    def task(rows):
        if not keeps:
            let_go()
        for batch in run(rows):
            yield batch
            del batch
            returned()
        returned()

    return df.mapInArrow(task, schema)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors of a cluster; local masters share the driver's files.

    Also bounds the Arrow batches of this session by rows and bytes, where it still has Spark's defaults.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    if spark.conf.get(BYTES_KEY).rstrip("bB") == str(64 << 20):
        spark.conf.set(BYTES_KEY, str(BATCH_BYTES))
    if sc.master.startswith("local"):
        os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([PACKAGE_ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
        sc.environment.setdefault("PYTHONPATH", os.environ["PYTHONPATH"])
        return
    if getattr(sc, "_ledgerloom_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "ledgerloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(os.path.join(PACKAGE_ROOT, "ledgerloom")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(top, name), os.path.relpath(os.path.join(top, name), PACKAGE_ROOT))
    sc.addPyFile(path)
    sc._ledgerloom_shipped = True
