"""The folder that driver and executors share, and a log of small files in it that readers always see whole."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and the master is local, as in tests, one of our own."""
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or (set_.get() if set_.isDefined() else None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def on_disk(spark: SparkSession, path: str) -> str | None:
    """path as the disk knows it, or None where it is in another store, which only Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(at).toUri().getPath() if fs.getUri().getScheme() == "file" else None


class _Out:
    """Writes bytes to a file of any file system, a good many at a time."""

    PIECE = 1 << 20

    def __init__(self, stream):
        self.stream, self.held = stream, bytearray()

    def write(self, data: bytes) -> int:
        self.held += data
        if len(self.held) >= self.PIECE:
            self.flush()
        return len(data)

    def flush(self) -> None:
        if self.held:
            self.stream.write(bytes(self.held))
            self.held.clear()

    def close(self) -> None:
        self.flush()
        self.stream.close()


class Folder:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.path = path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, below: str = "") -> list[str]:
        at = self._at(below)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A file that is there whole or not at all; an error if there is one already."""
        draft = f".draft-{uuid.uuid4().hex}"
        with self.writer(draft) as out:
            out.write(text.encode())
        try:
            self._rename(draft, name, "NONE")
        finally:
            self.fs.delete(self._at(draft), False)

    def replace(self, draft: str, name: str) -> None:
        """Makes a file that was written under another name take the place of name, at once."""
        self._rename(draft, name, "OVERWRITE")

    def _rename(self, draft: str, name: str, how: str) -> None:
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(kind, 1)
        options[0] = getattr(kind, how)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self._at(draft), self._at(name), options)

    @contextmanager
    def writer(self, name: str) -> Iterator[_Out]:
        """A new file to write bytes to."""
        out = _Out(self.fs.create(self._at(name), True))
        try:
            yield out
        finally:
            out.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class StateLog:
    """States of a table, one JSON file each, numbered. The last is the present one; of two writers with the same number one fails."""

    KEPT = 2

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.names() if n.endswith(".json") and n[:-5].isdigit())

    def last(self) -> tuple[int, dict]:
        """Number and state; 0 and an empty one before the first commit."""
        numbers = self.numbers()
        return (numbers[-1], json.loads(self.folder.read(f"{numbers[-1]}.json"))) if numbers else (0, {})

    def commit(self, number: int, state: dict) -> list[dict]:
        """Makes state the present one and forgets all but the last few. Returns those that readers may still hold."""
        self.folder.create(f"{number}.json", json.dumps(state))
        numbers = self.numbers()
        for n in numbers[: -self.KEPT]:
            self.folder.delete(f"{n}.json")
        return [json.loads(self.folder.read(f"{n}.json")) for n in numbers[-self.KEPT :]]
