from pyspark.sql import functions as F

from ledgerloom.plans import formats
from ledgerloom.sources import files


def test_a_task_fills_folders_of_its_own(spark, tmp_path):
    rows = spark.range(0, 60, 1, 4).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("t"))
    formats._one_file_each(rows, str(tmp_path / "c"), "k", "t")
    parts = {p: {f.name.split("-")[1] for f in p.rglob("part-*")} for p in (tmp_path / "c").iterdir() if p.is_dir()}
    assert len(parts) > 4 and all(len(tasks) == 1 for tasks in parts.values())
    found = files.corpus(spark, str(tmp_path / "c"))
    assert sorted((r.agreement, r["count"]) for r in found.groupBy("agreement").count().collect()) == [(0, 20), (1, 20), (2, 20)]
    assert sorted(int(r.text) for r in files.texts(spark, str(tmp_path / "c"), "*.txt").collect()) == list(range(60))


def test_few_tasks_read_many_files(spark, tmp_path):
    (tmp_path / "1").mkdir()
    for i in range(2000):
        (tmp_path / "1" / f"{i}.txt").write_text("x")
    most = max(8, 4 * spark.sparkContext.defaultParallelism)
    assert files.corpus(spark, str(tmp_path)).rdd.getNumPartitions() <= most
    assert files.texts(spark, str(tmp_path), "*.txt").rdd.getNumPartitions() <= most
    assert files.corpus(spark, str(tmp_path)).count() == 2000
