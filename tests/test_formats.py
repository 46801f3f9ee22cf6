import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import files, sinks


def put(root, folder, name, data):
    at = root / folder
    at.mkdir(exist_ok=True)
    (at / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def test_what_a_json_file_holds_is_told_from_its_value(spark, tmp_path):
    pages = [{"page": 4, "ocr_used": True, "text": "one\ntwo"}, "bare", {"text": 5}, {}]
    topics = {"Wage Information": ["[x]", 7, None, ["deep"]], "leave_information": "[not a list", "LEAVE information": "first", "none": None, "other": {"a": 1}}
    put(tmp_path, "3", "pages.json", json.dumps(pages, indent=2))
    put(tmp_path, "cao=12", "topics.json", json.dumps(topics, indent=1))
    put(tmp_path, "3", "scalar.json", '"text"')
    put(tmp_path, "3", "cut.json", "[{")
    put(tmp_path, "3", "empty.json", "")
    put(tmp_path, "notes", "other.json", "[]")
    root = str(tmp_path)
    got = [(r.agreement, r.file, r.page, r.ocr_used, r.text) for r in files.pages(spark, root).collect()]
    assert got == [(3, "pages.json", 4, True, "one\ntwo"), (3, "pages.json", 2, None, "bare"), (3, "pages.json", None, None, "5"), (3, "pages.json", None, None, None)]
    found = files.topics(spark, root).collect()
    assert [(r.agreement, r.topics) for r in found] == [(12, {"wage_information": ["[x]", "7", '["deep"]'], "leave_information": ["[not a list"], "none": [], "other": ['{"a":1}']})]
    assert sorted((r.file, r.reason) for r in files.unread(spark, root).collect()) == [("cut.json", "no JSON"), ("scalar.json", "neither a list nor an object")]


def test_json_lines_strict_and_tolerant(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "x"}\n\n  \n{"k": "one", "v": "y"}\n{"k": 2\n[1]\n{"k": 3}\n')
    good, bad = files.json_lines(spark, str(tmp_path), "k int, v string", strict=False)
    assert sorted((r.k, r.v) for r in good.collect()) == [(1, "x"), (3, None)] and good.select("v").count() == 2
    assert sorted(r.line for r in bad.collect()) == ["[1]", '{"k": "one", "v": "y"}', '{"k": 2'] and bad.first().file.endswith("a.jsonl")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        files.json_lines(spark, str(tmp_path), "k int, v string")[0].collect()


def test_listing_reads_no_contents(spark, tmp_path, capsys):
    put(tmp_path, "7", "a b+c.bin", b"\x00" * 10)
    found = files.corpus(spark, str(tmp_path))
    assert [tuple(r) for r in found.select("agreement", "file", "n_bytes").collect()] == [(7, "a b+c.bin", 10)]
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<path:string,length:bigint>" in plan and "content:binary" not in plan and "content#" not in plan


def test_files_of_many_forms_are_one_table(spark, tmp_path):
    text = "id{0}name{0}more\n1{0}\"a;b,c\td\"{0}é\n2{0}x{0}\n"
    data = {"a.csv": text.format(";").encode(), "b.csv": b"\xef\xbb\xbf" + text.format(",").encode(), "c.csv": text.format("\t").encode("latin-1"), "d.csv": b"\xff\xfe" + text.format(",").encode("utf-16-le"), "e.csv": b"\xfe\xff" + text.format(";").encode("utf-16-be"), "f.csv": b"name;id\r\nz;9\r\n", "g.csv": b""}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    rows = sorted((tuple(r) for r in files.mixed_tables(spark, str(tmp_path)).select("id", "name", "more").collect()), key=repr)
    assert rows == sorted([("1", "a;b,c\td", "é"), ("2", "x", None)] * 5 + [("9", "z", None)], key=repr)
    assert files.forms(spark, str(tmp_path)).count() == 6
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "d.csv")).select("id", "more").collect()] == [("1", "é"), ("2", None)]
    with pytest.raises(ValueError):
        files.mixed_tables(spark, str(tmp_path / "g.csv"))


def test_a_failed_replacement_leaves_the_old_state(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k int, v string"
    sinks.replace_partitions(spark.createDataFrame([(k, f"old{k}") for k in range(6)], schema), path, ["k"])
    state = lambda: sorted((r.k, r.v) for r in spark.read.parquet(path).collect())
    before = state()
    broken = spark.range(0, 6, 1, 6).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") == 5, F.raise_error(F.lit("task lost")).cast("string")).otherwise("new").alias("v"))
    with pytest.raises(Exception, match="task lost"):
        sinks.replace_partitions(broken, path, ["k"])
    assert state() == before
    sinks.replace_partitions(broken.where("k in (1, 2)"), path, ["k"])
    assert state() == [(k, "new" if k in (1, 2) else f"old{k}") for k in range(6)]


def test_a_report_is_text_in_order(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2, 0.5), (None, 1, 12.25), ("a", None, 1.0)], "name string, n int, share double")
    lines = sinks.report_lines([("FIRST PART", rows, "%-4s%3d %5.1f%%", ["name", "n", "share"], ["share"]), ("NONE", rows.where("n > 9"), "%s", ["name"], ["name"]), ("MANY", spark.range(300), "%d.", ["id"], ["id"])])
    sinks.write_report(lines, str(tmp_path / "r"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "r").glob("part-*")))
    assert text.split("\n")[:11] == ["FIRST PART", "----------", "b     2   0.5%", "a - 1.0", "-     1  12.3%", "", "NONE", "----", "(none)", "MANY", "----"]
    assert text.split("\n")[11:] == [f"{i}." for i in range(300)] + ["", ""]
    with pytest.raises(ValueError):
        sinks.report_lines([])
