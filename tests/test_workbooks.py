import os
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import files, workbooks

HEAD = '<?xml version="1.0"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(path, sheets, shared=(), styles="", later=False):
    """A workbook as other programs write it: shared strings, styles, absolute and relative parts."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><workbookPr date1904="{int(later)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{9 - i}" r:id="x{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="x{i}" Type="t" Target="{"/xl/" if i else ""}s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si>{x}</si>" for x in shared) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
        for i, body in enumerate(sheets.values()):
            z.writestr(f"xl/s{i}.xml", HEAD + body + "</sheetData></worksheet>")


def test_what_other_programs_write(spark, tmp_path):
    styles = '<numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/><numFmt numFmtId="171" formatCode="0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="22"/></cellXfs>'
    first = (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2"><v>5.0</v></c><c r="AB2" t="inlineStr"><is><t>far</t></is></c></row>'
        '<row r="3"/><row><c t="b"><v>1</v></c><c><v>1.50</v></c><c t="e"><v>#REF!</v></c><c s="1"><v>44197</v></c><c s="2"><v>60</v></c><c s="3"><v>3</v></c><c s="4"><v>44197.75</v></c><c t="str"><v>f</v></c></row>'
    )
    book(tmp_path / "a.xlsx", {"One": first, "Two &amp; more": '<row><c t="s"><v>2</v></c></row>'}, ["<t>name </t>", "<r><t>ri</t></r><r><t>ch</t></r><rPh><t>sound</t></rPh>", "<t/>"], styles)
    rows = {(r.sheet, r.row): r.cells for r in workbooks.sheet_rows(spark, str(tmp_path)).collect()}
    assert rows == {("One", 2): ["name ", None, "rich", "5"] + [None] * 23 + ["far"], ("One", 4): ["TRUE", "1.50", None, "2021-01-01", "1900-02-28", "3", "2021-01-01 18:00:00", "f"], ("Two & more", 1): [""]}
    assert workbooks.sheets(spark, str(tmp_path)).count() == 2
    found = files.table(spark, str(tmp_path / "a.xlsx"))
    assert found.columns == ["name", "rich", "5", "far"] and [tuple(r) for r in found.collect()] == [("TRUE", None, "2021-01-01", None)]
    book(tmp_path / "later.xlsx", {"S": '<row><c t="s"><v>0</v></c></row><row><c s="1"><v>0</v></c></row>'}, ["<t>at</t>"], styles, later=True)
    assert [r["at"] for r in workbooks.table(spark, str(tmp_path / "later.xlsx"), "S").collect()] == ["1904-01-01"]


def test_a_folder_of_workbooks_is_one_table(spark, tmp_path):
    cell = lambda *x: "<row>" + "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in x) + "</row>"
    book(tmp_path / "a.xlsx", {"S": cell("id", "name", "", "id") + cell("1", "x", "lost", "2")})
    book(tmp_path / "b.xlsx", {"S": cell("name", "more", "id") + cell("y", "m", "3") + cell("z"), "T": cell("other")})
    book(tmp_path / "c.xlsx", {"S": ""})
    assert sorted(tuple(r) for r in workbooks.table(spark, str(tmp_path), "S").fillna("-").collect()) == [("-", "z", "-"), ("1", "x", "-"), ("3", "y", "m")]
    (tmp_path / "d.xlsx").write_text("no workbook")
    with pytest.raises(Exception, match="is no workbook"):
        workbooks.sheet_rows(spark, str(tmp_path)).collect()
    assert workbooks.sheet_rows(spark, str(tmp_path), tolerant=True).where("sheet = 'T'").count() == 1


def test_what_is_written_is_read_back(spark, tmp_path, monkeypatch):
    rows = [(2, 'a <b> & "c"\r\n]]>', 1.5, True), (1, None, float("nan"), None), (3, " \x01é😀 ", -2.0, False)]
    df = spark.createDataFrame(rows, "id long, text string, x double, ok boolean").repartition(3)
    path = str(tmp_path / "out.xlsx")
    for _ in range(2):  # the second takes the place of the first
        workbooks.write(spark, {"A & <1>": df, "empty": df.where("id > 9")}, path, {"A & <1>": ["id"]})
    assert os.listdir(tmp_path) == ["out.xlsx"] or sorted(os.listdir(tmp_path))[-1] == "out.xlsx" and len([n for n in os.listdir(tmp_path) if n.endswith("xlsx")]) == 1
    got = [tuple(r) for r in workbooks.table(spark, path, "A & <1>").collect()]
    assert got == [("1", None, None, None), ("2", 'a <b> & "c"\r\n]]>', "1.5", "TRUE"), ("3", " é😀 ", "-2", "FALSE")]
    assert [r.cells for r in workbooks.sheet_rows(spark, path, "empty").collect()] == [["id", "text", "x", "ok"]]
    assert {r.sheet for r in workbooks.sheets(spark, path).collect()} == {"A & <1>", "empty"}
    for name in ("", "x" * 32, "a/b"):
        with pytest.raises(ValueError, match="name"):
            workbooks.write(spark, {name: df}, path)
    monkeypatch.setattr(workbooks, "MOST_ROWS", 3)
    with pytest.raises(ValueError, match="too many"):
        workbooks.write(spark, {"A": df}, str(tmp_path / "more.xlsx"))
    broken = df.where("id < 3").withColumn("text", F.raise_error(F.lit("boom")).cast("string"))
    with pytest.raises(Exception, match="boom"):
        workbooks.write(spark, {"A": broken}, path)
    assert workbooks.table(spark, path, "A & <1>").count() == 3
