import re
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import formats
from ledgerloom.sources import files, sinks


def processes() -> int:
    """How many processes and threads were started on this machine so far."""
    with open("/proc/stat") as stat:
        return int(next((line.split()[1] for line in stat if line.startswith("processes ")), 0))


def test_a_file_takes_no_process_of_its_own(spark, tmp_path):
    rows = spark.range(0, 600, 1, 4).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("t"))
    formats._one_file_each(rows, str(tmp_path / "first"), "k", "t")
    if not (before := processes()):
        pytest.skip("the machine does not count them")
    formats._one_file_each(rows, str(tmp_path / "second"), "k", "t")
    assert processes() - before < 300
    assert sum(1 for _ in (tmp_path / "second").rglob("part-*.txt")) == 600


def test_what_a_file_holds(spark, tmp_path):
    texts = {1: "é\n\n", 2: "", 3: None, -4: "x", None: "y"}
    formats._one_file_each(spark.createDataFrame(list(texts.items()), "k int, t string"), str(tmp_path / "c"), "k", "t")
    found = {f.parent.name: f.read_bytes().decode() for f in (tmp_path / "c").rglob("part-*.txt")}
    assert found == {f"agreement={'__HIVE_DEFAULT_PARTITION__' if k is None else k}": f"{t or ''}\n" for k, t in texts.items()}
    assert not (tmp_path / "c" / "_temporary").exists()
    with pytest.raises(FileExistsError):
        formats._one_file_each(spark.createDataFrame([(1, "z")], "k int, t string"), str(tmp_path / "c"), "k", "t")
    formats._one_file_each(spark.createDataFrame([], "k int, t string"), str(tmp_path / "none"), "k", "t")
    assert files.listing(spark, str(tmp_path / "none")).collect() == []


def test_only_committed_attempts_count(tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 7)))
    writer = sinks._FilesWriter(str(tmp_path))
    batch = pa.RecordBatch.from_pydict({"part": [1, 1], "agreement": [5, 5], "text": [b"a", b"b"]})

    def broken():
        yield batch
        raise ValueError

    with pytest.raises(ValueError):
        writer.write(broken())
    writer.write(iter([batch]))  # ends after another attempt, not committed
    writer.commit([writer.write(iter([batch])), None])
    assert sorted(f.read_bytes() for f in tmp_path.rglob("part-*.txt")) == [b"a\n", b"b\n"]
    assert [f.name for f in tmp_path.iterdir()] == ["part=1"]


def test_the_driver_gets_no_file_of_a_folder_on_disk(spark, tmp_path):
    for i in range(50):
        (tmp_path / str(i % 5)).mkdir(exist_ok=True)
        (tmp_path / str(i % 5) / f"{i}.txt").write_text("x" * i)
    found = files.listing(spark, str(tmp_path))  # 0.txt is empty
    assert found.inputFiles() == [] and sorted(r.n_bytes for r in found.collect()) == list(range(50))


@pytest.mark.parametrize("pattern", ["*", "*.{json,txt}", "[!a]?*", "a.txt"])
def test_a_folder_on_disk_is_listed_as_spark_lists_it(spark, tmp_path, pattern):
    names = ("1/a.txt", "1/b c.json", "1/é+ü.txt", "1/_hidden.txt", "1/.dot.txt", "1/_x=1.txt", "1/_metadata", "_metadata_of/3/a.txt", "k=2/a.txt", "2/deep/3/a.md", "2/deep/4x/a.txt", "_away/5/a.txt", ".away/5/a.txt", "_k=6/7/a.txt", "a.txt", "8/x._COPYING_")
    for n, name in enumerate(names, 1):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * n)
    (tmp_path / "9").symlink_to(tmp_path / "1")
    (tmp_path / "1" / "gone.txt").symlink_to(tmp_path / "nowhere")
    (tmp_path / "10").mkdir()
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(str(tmp_path)).select("path", "length").collect()
    placed = ((re.search(r"/(?:[^/=]+=)?(\d+)/([^/]+)$", r.path), r.length) for r in own)
    want = sorted((int(m[1]), m[2], n) for m, n in placed if m)
    assert want and sorted((r.agreement, r.file, r.n_bytes) for r in files.listing(spark, str(tmp_path), pattern).collect()) == want


def test_names_that_look_like_encoded_ones(spark, tmp_path):
    (tmp_path / "1").mkdir()
    for name in ("50%.txt", "a%20b.txt", "a+b.txt"):
        (tmp_path / "1" / name).write_text("x")
    assert sorted(r.file for r in files.listing(spark, f"file://{tmp_path}").collect()) == ["50%.txt", "a%20b.txt", "a+b.txt"]
    assert [r.file for r in files.listing(spark, str(tmp_path / "*"), "a+*").collect()] == ["a+b.txt"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.listing(spark, str(tmp_path / "2"))


def test_a_store_that_only_spark_reaches(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.away.link./in", f"file://{tmp_path}")
    rows = spark.range(0, 12, 1, 2).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("t"))
    formats._one_file_each(rows, "viewfs://away/in/c", "k", "t")
    found = files.listing(spark, "viewfs://away/in/c")
    assert sorted((r.agreement, r["count"], r.n) for r in found.groupBy("agreement").agg(F.count("*").alias("count"), F.sum("n_bytes").alias("n")).collect()) == [(0, 4, 8), (1, 4, 9), (2, 4, 9)]
    assert sorted(int(r.text) for r in files.texts(spark, "viewfs://away/in/c", "*.txt").collect()) == list(range(12))
