from pyspark.sql import functions as F

from ledgerloom.functions import dates, missing, numbers, text
from ledgerloom.operators import periods, screening


def values(spark, rows, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_missing_values_have_five_meanings(spark):
    rows = [None, "", " ", "Empty", "x"]
    assert values(spark, rows, lambda v: ~missing.has_text(v)) == [True, True, True, False, False]
    assert values(spark, rows, missing.is_placeholder) == [True, True, True, True, False]
    assert values(spark, rows, lambda v: missing.is_placeholder(v, missing.CELL_PLACEHOLDERS)) == [True, True, False, True, False]
    assert values(spark, rows, missing.is_truthy) == [False, False, True, True, True]
    df = spark.createDataFrame([(None, None), ("", ""), (None, ""), ("a", None)], "a string, b string")
    assert [r[0] for r in df.select(missing.row_is_empty(["a", "b"])).collect()] == [True, True, False, False]


def test_names(spark):
    assert values(spark, [" A_b\nC "], text.column_name) == ["a b c"]
    assert values(spark, ["Lo on-1.x.PDF"], text.file_key) == ["loon1x"]
    assert values(spark, ["a%20b+c%3A.pdf", "bad%zz", "a/b?c  d"], text.safe_file_name) == ["a b+c.pdf", "bad%zz", "abc d"]
    assert values(spark, ["http://h/x/y.pdf?q=1", "http://h"], text.url_basename) == ["y.pdf", ""]
    assert values(spark, ["x.md.json", "none"], text.stem) == ["x.md", "none"]


def test_glyphs(spark):
    assert values(spark, ["/uni03BB//uni0041/ uni0042x"], text.decode_uni) == ["λA Bx"]
    assert values(spark, ["/G65/G955 G66 /G99999999"], text.decode_glyphs) == ["Aλ B /G99999999"]
    assert values(spark, ["a/b/c x/\ny  z /", "1/2"], text.clean_slashes) == ["ab/c x\ny z", "12"]
    assert values(spark, ["a\n\n\n\nb"], lambda v: text.clean_slashes(v, True)) == ["a\n\nb"]
    assert values(spark, ["/uni0041/uni0042/ /uni0043/"], lambda v: text.count_matches(v, text.UNI)) == [2]


def test_json_texts(spark):
    fenced = '```json\n{"a": [1, 2,], }\n```'
    assert values(spark, [fenced], lambda v: F.try_variant_get(F.try_parse_json(text.clean_json_text(v)), "$.a[1]", "int")) == [2]
    assert values(spark, ['x ﻿{“a”: 1} y', "none"], text.outermost_object) == ['{"a": 1}', "none"]
    repaired = values(spark, ['{"a": 1}', 'so: {"a": 1,} end', '{"k": ["v"], "m": [', "words"], lambda v: text.repair_json(v, ["k", "m"]))
    assert repaired == ['{"a": 1}', '{"a": 1}', '{"k": ["v"]}', '{"text":"words"}']


def test_similarities(spark):
    df = spark.createDataFrame([("", ""), ("a", ""), ("abc", "ABD"), ("The salary grows", "a growing salary")], "a string, b string")
    got = [tuple(r) for r in df.select(text.character_similarity(F.col("a"), F.col("b")), text.term_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == (1.0, 1.0) and got[1] == (0.0, 0.0) and got[2][0] == 0.5 and got[3][1] == 1 / 3
    assert values(spark, ["Année, où l'été"], text.words) == [["année", "où", "l", "été"]]


def test_dates(spark):
    assert values(spark, ["31/12/2020", "2020-1-5", "1 January 2024", "31/02/2020", "  x ", ""], dates.iso_or_same) == ["2020-12-31", "2020-01-05", "1 January 2024", "31/02/2020", "x", None]
    assert values(spark, ["Ingangsdatum 1.2.2020", "x ingangsdatum: 01-02-20 y", "none"], lambda v: dates.labelled(v, "Ingangsdatum")) == ["1.2.2020", "01-02-20", None]
    df = spark.createDataFrame([("01/02/2020",), ("13/01/2020",), ("x",)], "d string")
    assert [str(r.p) for r in dates.parse_column(df, "d", "p").collect()] == ["2020-02-01", "2020-01-13", "None"]
    df = spark.createDataFrame([("01/13/2020",), ("01/14/95",), ("03/02/2020",)], "d string")
    assert [str(r.p) for r in dates.parse_column(df, "d", "p").collect()] == ["2020-01-13", "None", "2020-02-03"]


def test_numbers(spark):
    one = spark.range(1)
    row = one.select(numbers.half_even(F.lit(2.5), 0), numbers.share(F.lit(1), F.lit(0)), numbers.retry_seconds(F.lit(1.0), F.lit(2)), numbers.ratio_class(F.lit(2.0)), numbers.ratio_class(F.lit(0.0))).first()
    assert tuple(row) == (2.0, 0.0, int((262144 / 125000 * 4 + 3) * 60), "similar", None)


def test_periods_without_rows(spark):
    df = spark.createDataFrame([], "k int, s date, e date, t int")
    assert periods.gaps(df, "k", "s", "e", "t").count() == 0 and periods.renewals(df, "k", "s", "e", "t").count() == 0
    assert periods.histogram(df, "t").count() == 0
    same = spark.createDataFrame([(5,), (5,)], "t int")
    assert [(r.bin, r.n, r.low) for r in periods.histogram(same, "t").collect()] == [(15, 2, 5.0)]


def test_page_choice(spark):
    df = spark.createDataFrame([(True, "n", " o "), (False, "n", "o"), (False, "", None), (True, "n", "  ")], "i boolean, n string, o string")
    assert [tuple(r) for r in df.select(*screening.page_text(F.col("i"), F.col("n"), F.col("o"))).collect()] == [("o", True), ("n", False), ("[EMPTY PAGE]", False), ("[EMPTY PAGE]", True)]
