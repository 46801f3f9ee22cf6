"""Workbooks of several sheets, in the open format of zipped XML: sheets are read side by side, a task each, and rows written as Spark makes them.

The files come and go through Spark's own file systems. A row of a sheet is read as it streams by; what a task holds is the file and its shared strings.
Values come as text: numbers as they are written (whole ones without a fraction), truth values as TRUE and FALSE, dates and times in ISO form where the cell's
format says so. Empty cells and errors are null. A file that is no workbook is an error, or gives no rows if asked for.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ledgerloom.storage import Folder

#: Rows of a sheet that the format allows.
MOST_ROWS = 1 << 20
#: Namespaces, built-in number formats that are dates or times, and parts of a workbook. Fixed values of the format.
MAIN, RELATIONS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
TYPES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{}</Types>"""
SHEET_TYPE = '<Override PartName="/xl/worksheets/sheet{}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
ROOT = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>"""
RELATION = '<Relationship Id="rId{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'
BOOK = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{}</sheets></workbook>"""
SHEET_HEAD = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>"""


class _Book:
    """A workbook's sheets by name, its shared strings and which cell formats are dates."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        of = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        parts = {s.get("name", ""): of.get(s.get(f"{RELATIONS}id"), "") for s in book.iter(f"{MAIN}sheet")}
        self.sheets = {name: part.lstrip("/") if part.startswith("/") else f"xl/{part}" for name, part in parts.items()}
        later = book.find(f"{MAIN}workbookPr")
        self.start = datetime.datetime(1904, 1, 1) if later is not None and later.get("date1904") in ("1", "true") else datetime.datetime(1899, 12, 30)

    def _part(self, name: str) -> ElementTree.Element | None:
        return ElementTree.fromstring(self.zip.read(name)) if name in self.zip.namelist() else None

    def strings(self) -> list[str]:
        root = self._part("xl/sharedStrings.xml")
        return [] if root is None else ["".join(t.text or "" for t in _texts(item)) for item in root.iter(f"{MAIN}si")]

    def dates(self) -> list[bool]:
        root = self._part("xl/styles.xml")
        if root is None:
            return []
        plain = {f.get("numFmtId"): re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", f.get("formatCode", "")) for f in root.iter(f"{MAIN}numFmt")}
        shown = lambda i: int(i) in DATE_FORMATS or bool(re.search("[ymdhs]", plain.get(i, ""), re.I))
        formats = root.find(f"{MAIN}cellXfs")
        return [] if formats is None else [shown(x.get("numFmtId", "0")) for x in formats]

    def rows(self, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
        """Number and cells of each row that has any."""
        strings, dates, last = self.strings(), self.dates(), 0
        for _, row in ElementTree.iterparse(self.zip.open(self.sheets[sheet])):
            if row.tag != f"{MAIN}row":
                continue
            last, cells = int(row.get("r") or last + 1), []
            for cell in row.iter(f"{MAIN}c"):
                at = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                cells[at] = self._value(cell, strings, dates)
            row.clear()
            if any(c is not None for c in cells):
                yield last, cells

    def _value(self, cell: ElementTree.Element, strings: list[str], dates: list[bool]) -> str | None:
        kind, found = cell.get("t", "n"), cell.find(f"{MAIN}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in _texts(cell))
        text = found.text if found is not None else None
        if text is None or kind == "e":
            return None
        if kind == "s":
            return strings[int(text)]
        if kind == "b":
            return "TRUE" if text == "1" else "FALSE"
        style = int(cell.get("s", "0"))
        if kind != "n":
            return text
        if style < len(dates) and dates[style]:
            at = self.start + datetime.timedelta(days=float(text))
            at = (at + datetime.timedelta(microseconds=500_000)).replace(microsecond=0)  # a fraction of a day holds no exact second
            return at.date().isoformat() if at.time() == datetime.time() else at.isoformat(" ")
        return text[:-2] if re.fullmatch(r"-?\d+\.0", text) else text


def _texts(item: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """The texts of a string, without those that only tell how it sounds."""
    for child in item:
        if child.tag == f"{MAIN}t":
            yield child
        elif child.tag != f"{MAIN}rPh":
            yield from _texts(child)


def _column(name: str) -> int:
    n = 0
    for c in name:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def sheets(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """path, sheet, place (from 0) and content (of the whole file) of each sheet of the workbooks in path, each in a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    names = list(_Book(data).sheets)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    if not tolerant:
                        raise ValueError(f"{file} is no workbook: {e}") from e
                    continue
                for place, name in enumerate(names):
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((file, pa.string()), (name, pa.string()), (place, pa.int32()), (data, pa.binary()))], names=["path", "sheet", "place", "content"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, sheet string, place int, content binary").repartition("path", "sheet")


def sheet_rows(spark: SparkSession, path: str, sheet: str | None = None, tolerant: bool = False) -> DataFrame:
    """path, sheet, place, row (from 1) and cells of all rows that are not empty; of one sheet if it is named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, name, place, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held: list[tuple] = []
                for row, cells in _Book(data).rows(name):
                    held.append((file, name, place, row, cells))
                    if len(held) == 5000:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)

    found = sheets(spark, path, tolerant)
    return (found if sheet is None else found.where(F.col("sheet") == sheet)).mapInArrow(run, "path string, sheet string, place int, row int, cells array<string>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "sheet", "place", "row", "cells"])


def table(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet (the first where none is named) of one workbook or of all in a folder as a table, all text. The first row that is not empty is the header.

    Workbooks may have their columns in different orders; columns without a name are left out, and of two with one name the first counts.
    """
    rows = sheet_rows(spark, path, sheet).where(F.lit(True) if sheet is not None else F.col("place") == 0)
    heads = rows.groupBy("path").agg(F.min_by("cells", "row").alias("names"), F.min("row").alias("first")).withColumn("names", F.transform("names", lambda n: F.coalesce(F.trim(n), F.lit(""))))
    columns: dict[str, None] = {}
    for r in heads.groupBy("names").agg(F.min("path").alias("path")).orderBy("path").collect():  # a row for each different header
        columns |= dict.fromkeys(n for n in r.names if n)
    of = heads.select(F.col("path").alias("of"), "names", "first")
    body = rows.join(of, F.col("path") == F.col("of")).where(F.col("row") > F.col("first"))
    cell = lambda n: F.get("cells", (F.array_position("names", n) - 1).cast("int"))
    return body.select(*(F.when(F.array_contains("names", n), cell(n)).alias(n) for n in columns))


def _escaped(text: Column) -> Column:
    plain = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "")
    for mark, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        plain = F.replace(plain, F.lit(mark), F.lit(shown))
    return plain


def _cell(rows: DataFrame, name: str) -> Column:
    kind, own = rows.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, BooleanType):
        told = F.concat(F.lit('<c t="b"><v>'), own.cast("int"), F.lit("</v></c>"))
    elif isinstance(kind, NumericType):
        told = F.when(F.isnan(own.cast("double")) | (F.abs(own.cast("double")) == float("inf")), None).otherwise(F.concat(F.lit("<c><v>"), own.cast("string"), F.lit("</v></c>")))
    else:
        told = F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), _escaped(own.cast("string")), F.lit("</t></is></c>"))
    return F.coalesce(told, F.lit("<c/>"))


def write(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, order: Mapping[str, Sequence[str]] | None = None) -> None:
    """Writes tables as the sheets of one workbook, in place of an earlier one only when it is whole. order: columns that a sheet's rows are ordered by.

    Spark makes the XML of the rows; the driver takes them one partition after another and zips them into the file as they come. A sheet has fewer than
    MOST_ROWS rows, or nothing is written.
    """
    for name, rows in tables.items():
        if not re.fullmatch(r"[^\[\]:*?/\\]{1,31}", name):
            raise ValueError(f"no name for a sheet: {name!r}")
        if rows.limit(MOST_ROWS).count() >= MOST_ROWS:
            raise ValueError(f"{name} has too many rows for a sheet")
    where, _, file = path.rpartition("/")
    folder, draft = Folder(spark, where), f".draft-{file}"
    with folder.writer(draft) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        numbers = range(1, len(tables) + 1)
        z.writestr("[Content_Types].xml", TYPES.format("".join(map(SHEET_TYPE.format, numbers))))
        z.writestr("_rels/.rels", ROOT.format(RELATION.format(1, "officeDocument", "xl/workbook.xml")))
        z.writestr("xl/_rels/workbook.xml.rels", ROOT.format("".join(RELATION.format(i, "worksheet", f"worksheets/sheet{i}.xml") for i in numbers)))
        quoted = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
        z.writestr("xl/workbook.xml", BOOK.format("".join(f'<sheet name="{quoted(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(tables, 1))))
        for i, (name, rows) in enumerate(tables.items(), 1):
            rows = rows.orderBy(*order[name]) if order and name in order else rows
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as part:
                head = "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{quoted(c)}</t></is></c>' for c in rows.columns)
                part.write(f"{SHEET_HEAD}<row>{head}</row>".encode())
                for r in rows.select(F.concat(F.lit("<row>"), *(_cell(rows, c) for c in rows.columns), F.lit("</row>")).alias("x")).toLocalIterator():
                    part.write(r.x.encode())
                part.write(b"</sheetData></worksheet>")
    folder.replace(draft, file)
