import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.storage import Folder, StateLog
from ledgerloom.streaming import incremental
from ledgerloom.streaming.keyed import KeyedTable

SCHEMA = "k int, kind string, at int, v string"


def files_in(path):
    return sum(n.startswith("part-") for _, _, names in os.walk(path) for n in names)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("k", "kind", "at", "v").collect()), key=repr)


def test_keyed_table_is_the_last_row_of_each_key(spark, tmp_path):
    """Null keys, equal times and repeated rows; files stay few however many batches come; replayed batches change nothing."""
    table = KeyedTable(spark, str(tmp_path), ["k", "kind"], ["at"], buckets=2, versions=3)
    assert table.read() is None
    rng, want, counts = random.Random(1), {}, []
    for batch in range(14):
        rows = [(rng.choice([None, *range(6)]), rng.choice(["a", None]), rng.choice([None, *range(9)]), rng.choice("xyz")) for _ in range(rng.choice([0, 1, 12]))]
        rows += rows[:1] + [(7, "hot", batch % 4, str(i)) for i in range(30)]
        assert table.merge(spark.createDataFrame(rows, SCHEMA), batch)
        for k, kind, at, v in rows:
            own = (at is not None, at or 0, batch, v)
            want[k, kind] = max(want.get((k, kind), own), own)
        if batch == 5:
            assert not table.merge(spark.createDataFrame([(1, "a", 99, "again")], SCHEMA), 5)
        counts.append(files_in(tmp_path))
    assert rows_of(table.read()) == sorted(((k, kind, at if there else None, v) for (k, kind), (there, at, _, v) in want.items()), key=repr)
    assert max(counts[7:]) <= 2 * (2 + 3 * 2) and len(StateLog(spark, f"{tmp_path}/states").numbers()) == 2


def test_readers_keep_the_state_that_they_took(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["k"], ["at"], buckets=1, versions=2)
    frame = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    table.merge(frame((1, "a", 1, "x")), 0)
    before = table.read()
    table.merge(frame((1, "a", 2, "y"), (2, "a", 1, "z")), 1)  # the buckets are written anew
    assert rows_of(before) == [(1, "a", 1, "x")] and rows_of(table.read()) == [(1, "a", 2, "y"), (2, "a", 1, "z")]


def test_a_failed_batch_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path), ["k"], ["at"], buckets=1, versions=2)
    table.merge(spark.createDataFrame([(1, "a", 1, "x")], SCHEMA), 0)
    broken = spark.createDataFrame([(1, "a", 5, "y")], SCHEMA).withColumn("v", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        table.merge(broken, 1)
    monkeypatch.setattr(StateLog, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.merge(spark.createDataFrame([(1, "a", 6, "z")], SCHEMA), 1)
    monkeypatch.undo()
    assert rows_of(table.read()) == [(1, "a", 1, "x")]
    assert table.merge(spark.createDataFrame([(1, "a", 7, "w")], SCHEMA), 1) and rows_of(table.read()) == [(1, "a", 7, "w")]
    assert sum(n.startswith(("version-", "base-")) for n in os.listdir(tmp_path)) <= 3  # what failed batches left is gone


def test_of_two_writers_one_fails(spark, tmp_path):
    log = StateLog(spark, str(tmp_path))
    assert log.last() == (0, {})
    log.commit(1, {"a": "é"})
    with pytest.raises(Exception, match="exist"):
        log.commit(1, {"a": 2})
    assert log.last() == (1, {"a": "é"}) and Folder(spark, str(tmp_path)).names() == ["1.json"]


def test_recorded_figures(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "success boolean, seconds double"
    for n in range(5):
        spark.createDataFrame([(n != 2, 1.0 + n), (None, 0.5)], schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: incremental.recorded(spark, source, schema, target, mark, "success", "seconds", files=2, name="test-recorded")
    found = run()
    assert [f["rows"] for f in found] == [4, 4, 2] and sum(f["failures"] for f in found) == 6 and sum(f["seconds"] for f in found) == 17.5
    assert [f["batch"] for f in found] == [0, 1, 2] and all(f["took"] > 0 for f in found)
    assert run() == [] and spark.read.parquet(target).count() == 10
