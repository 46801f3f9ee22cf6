import json

import pytest
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators import content as C
from ledgerloom.operators import records
from ledgerloom.sources import extractors, files, sinks
from ledgerloom.streaming import incremental


@pytest.fixture
def corpus(tmp_path):
    for key, name, text in (
        ("10", "a b.json", json.dumps([{"page": 1, "ocr_used": False, "text": "one"}, {"page": 2, "ocr_used": True, "text": ""}])),
        ("2", "c.json", json.dumps({"Wage Information": ["x", "y"], "leave_information": "just text"})),
        ("2", "bad.json", "[{"),
        ("notes", "d.json", "[]"),
    ):
        (tmp_path / key).mkdir(exist_ok=True)
        (tmp_path / key / name).write_text(text)
    return str(tmp_path)


def test_corpus_listing_is_by_number(spark, corpus):
    rows = files.corpus(spark, corpus).orderBy("agreement", "file").collect()
    assert [(r.agreement, r.file) for r in rows] == [(2, "bad.json"), (2, "c.json"), (10, "a b.json")]
    assert all(r.size_mb == r.n_bytes / 1048576 for r in rows)


def test_pages_and_topics(spark, corpus):
    assert [(r.agreement, r.page, r.text) for r in files.pages(spark, corpus).where("page is not null").orderBy("page").collect()] == [(10, 1, "one"), (10, 2, "")]
    found = files.topics(spark, corpus).where("file = 'c.json'").first()
    assert found.topics == {"wage_information": ["x", "y"], "leave_information": ["just text"]}


def test_run_log_modes(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"filename": "a", "success": true}\n\n{"filename": "b", "total_tokens": 5, "model": "m"}\n')
    rows = {r.filename: r for r in files.run_log(spark, str(path)).collect()}
    assert rows["a"].model is None and rows["b"].total_tokens == 5
    path.write_text('{"filename": "a"}\n{broken\n')
    assert [r.filename for r in files.run_log(spark, str(path), strict=False).collect()] == ["a"]
    with pytest.raises(Exception):
        files.run_log(spark, str(path)).collect()


@pytest.mark.parametrize("sep,encoding", [(";", "utf-8"), (",", "utf-8"), ("\t", "latin-1")])
def test_csv_is_sniffed(spark, tmp_path, sep, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes(f"id{sep}name\n007{sep}Über\n".encode(encoding))
    assert files.sniff(spark, str(path))[0] == sep
    assert [tuple(r) for r in files.table(spark, str(path)).collect()] == [("007", "Über")]


def test_small_readers(spark, tmp_path):
    (tmp_path / "n.txt").write_text("a\n\n  b \n")
    assert [r.name for r in files.names(spark, str(tmp_path / "n.txt")).collect()] == ["a", "b"]
    df = spark.createDataFrame([("Yes", "3"), ("No", "4"), ("Yes", "x"), (None, "5")], "needed string, k string")
    assert [r.k for r in files.flagged_keys(df, "needed", "k").collect()] == [3]
    df = spark.createDataFrame([(0, "name ", "age"), (1, "x", "7")], "n int, _1 string, _2 string")
    assert [r.asDict() for r in files.promoted_header(df, "n").collect()] == [{"n": 1, "name": "x", "age": "7"}]
    with pytest.raises(ValueError):
        files.table(spark, "a.docx")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    sinks.write_table(df, str(tmp_path / "t"), {"name": "who"})
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.schema["name"].metadata == {"comment": "who"} and back.count() == 2
    sinks.write_csv(df, str(tmp_path / "c"), ";")
    assert files.csv(spark, str(tmp_path / "c"), sep=";").count() == 2
    up = sinks.upserted(df, spark.createDataFrame([(2, "b"), (2, "c"), (3, "d")], "id int, name string"), ["id"])
    assert sorted(tuple(r) for r in up.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    rows = sinks.checked_json(spark.createDataFrame([('{"a":  1}',), ("{",)], "j string"), "j").collect()
    assert [(r.is_valid, r.pretty) for r in rows] == [(True, '{"a":1}'), (False, "{")]
    good, bad = sinks.failures(spark.createDataFrame([(1, True, None), (2, False, "why"), (3, None, None)], "id int, ok boolean, reason string"), "ok", "reason")
    assert [r.id for r in good.collect()] == [1] and sorted((r.id, r.failure) for r in bad.collect()) == [(2, "why"), (3, "unknown")]


def test_extractor_failures_stay_in_their_row(spark):
    df = spark.createDataFrame([(1, "Het loon is 5\nniets\nverlof"), (2, "boom"), (3, None)], "id int, text string")

    def extractor(text):
        if text == "boom":
            raise ValueError("bad")
        return extractors.by_keywords(text)

    rows = {r.id: r for r in extractors.extracted(df, ["id"], "text", extractor).collect()}
    assert rows[1].topics == {"wage": ["Het loon is 5"], "general": ["niets"], "leave": ["verlof"]} and rows[1].success
    assert (rows[2].success, rows[2].error_message, rows[2].topics) == (False, "ValueError: bad", None)
    assert rows[3].topics == {}


def test_columns_are_resolved_on_the_driver():
    columns = ["CAO_Number", "Start date\n(contract)", "pension_age", "shift_compensation"]
    assert C.resolve(columns, ["cao_number", "cao number"]) == "CAO_Number"
    assert C.resolve(columns, ["start date"]) == "Start date\n(contract)" and C.resolve(columns, ["x"]) is None
    assert C.column_groups(columns, {"pension": ["pension", "retire"], "overtime": ["shift_compensation"]}) == {"pension": ["pension_age"], "overtime": ["shift_compensation"]}
    assert C.schema_coverage(["a", "b"], ["a"], ["c"]) == {"common": ["a"], "missing": ["b"], "extra": ["c"]}
    assert len(schemas.records(["a", "b"])) == 2


def test_incremental_runs_read_new_files_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "k int, at string, v int"
    run = lambda: incremental.run_new(spark, source, schema, target, mark, lambda df: df.withColumn("w", F.col("v") * 2))
    spark.createDataFrame([(1, "a", 1)], schema).write.mode("append").parquet(source)
    run(), run()
    assert spark.read.parquet(target).count() == 1
    spark.createDataFrame([(2, "b", 2)], schema).write.mode("append").parquet(source)
    run()
    assert sorted(r.w for r in spark.read.parquet(target).collect()) == [2, 4]


def test_upserts_keep_the_latest(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "k int, at string, v int"
    for rows in ([(1, "a", 1), (2, "c", 2)], [(1, "b", 3), (2, "b", 4), (3, "a", 5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.upsert_log(spark, source, schema, target, mark, ["k"], "at")
    assert sorted((r.k, r.v) for r in incremental.latest(spark, target, ["k"], "at").collect()) == [(1, 3), (2, 2), (3, 5)]


def test_extracting_bytes_to_many_rows(spark):
    df = spark.createDataFrame([(1, bytearray(b"salary 5\nverlof 2\nwage")), (2, None)], "id long, content binary")
    found = extractors.extracted(df, ["id"], "content", lambda b: extractors.by_keywords(b.decode()))
    assert found.where("success").count() == 2
    assert sorted(tuple(r) for r in extractors.items(found, ["id"]).collect()) == [(1, "leave", 0, "verlof 2"), (1, "wage", 0, "salary 5"), (1, "wage", 1, "wage")]


def test_names_after_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "n.txt").write_bytes("\ufeff first \n\n second".encode())
    assert [r.name for r in files.names(spark, str(tmp_path / "n.txt")).collect()] == ["first", "second"]


def test_lists_in_lists(spark):
    df = spark.sql("SELECT array(array(array('a', 'b'), array('c')), array(array('d'))) AS t, array('x') AS one")
    assert tuple(df.select(records.joined_lists(df.t, 3), records.joined_lists(df.one, 1)).first()) == (["a | b | c", "d"], ["x"])


def test_extractors_as_a_table_function(spark):
    df = spark.createDataFrame([(1, "Het loon is 5\nniets\n\n  verlof  \nsalary"), (2, "boom"), (3, None), (4, "")], "id int, text string")

    def extractor(text):
        if text == "boom":
            raise ValueError("bad")
        return extractors.by_keywords(text)

    want = [(1, "general", 0, "niets", None), (1, "leave", 0, "verlof", None), (1, "wage", 0, "Het loon is 5", None), (1, "wage", 1, "salary", None), (2, None, None, None, "ValueError: bad")]
    assert sorted((tuple(r) for r in extractors.extracted_lines(df, ["id"], "text", extractor).collect()), key=repr) == want
    extractors.register(spark, {"letters": lambda b: {"n": list(b.decode())}}, "of_letters")
    df.selectExpr("id", "cast(text AS binary) AS b").createOrReplaceTempView("letters_of")
    assert [tuple(r) for r in spark.sql("SELECT id, item, line FROM letters_of, LATERAL of_letters(b, 'letters') WHERE id = 2 ORDER BY item").collect()] == [(2, i, c) for i, c in enumerate("boom")]
    for wrong in ("of_letters(b, 'none')", "of_letters(id, 'letters')"):
        with pytest.raises(Exception, match="no extractor|texts or binary"):
            spark.sql(f"SELECT * FROM letters_of, LATERAL {wrong}")
