"""Readers of corpus folders, tables and logs. All but the sniffing of a file's first lines is left to Spark's readers."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import batched
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.missing import has_text
from ledgerloom.operators.runlog import RUN_LOG
from ledgerloom.sources import workbooks
from ledgerloom.storage import on_disk

#: Separators and encodings that a table is tried with, in order.
SEPARATORS, ENCODINGS = (";", ",", "\t"), ("UTF-8", "ISO-8859-1")


def _keyed(files: DataFrame, path: str) -> DataFrame:
    """Adds agreement, the numeric folder that a file lies in (7, or name=7 as Spark writes it), and file, its name; files elsewhere are left out."""
    plain, form = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"/(?:[^/=]+=)?(\d+)/([^/]+)$"
    key, name = (F.regexp_extract(plain, form, n) for n in (1, 2))
    return files.withColumns({"agreement": key.try_cast("int"), "file": name}).where("agreement is not null")


def _tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _few(files: DataFrame) -> DataFrame:
    """The same rows in a bounded number of tasks: Spark counts each small file as 4 MB, which makes a task of every few files."""
    return files.coalesce(_tasks(files.sparkSession))


#: Files in a batch of a listing.
LISTED = 10_000


def _shown(name: str, is_folder: bool) -> bool:
    """Whether Spark's readers see a file or folder of this name."""
    hidden = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
    return not hidden or (is_folder and name.startswith(("_common_metadata", "_metadata")))


def _entries(folder: str) -> Iterator[os.DirEntry]:
    """What lies in a folder; nothing if it is gone."""
    try:
        with os.scandir(folder) as found:
            yield from (e for e in found if _shown(e.name, e.is_dir()))
    except FileNotFoundError:
        return


def _listed(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, encoded as in a URL, and length of all files in a folder on disk and below it, but those that Spark's readers take for hidden."""
    form = re.compile(spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern(), re.DOTALL)
    alone, tops = [], [root]
    while tops and len(tops) < spark.sparkContext.defaultParallelism:  # goes down until there are enough to share
        alone, tops = alone + tops, [e.path for top in tops for e in _entries(top) if e.is_dir()]

    def walk(folder: str, deep: bool) -> Iterator[tuple[str, int]]:
        left = [folder]
        while left:
            at = left.pop()
            above = quote(os.fsencode(at))
            for e in _entries(at):
                if e.is_dir():
                    left += [e.path] if deep else []
                elif form.fullmatch(e.name):
                    try:
                        yield f"{above}/{quote(os.fsencode(e.name))}", e.stat().st_size
                    except FileNotFoundError:
                        pass  # gone since, or a link to nothing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, deep in zip(batch.column("folder").to_pylist(), batch.column("deep").to_pylist(), strict=True):
                for some in batched(walk(os.fsdecode(folder), deep), LISTED):
                    yield pa.RecordBatch.from_arrays([pa.array([s[i] for s in some], kind) for i, kind in enumerate((pa.string(), pa.int64()))], names=["path", "length"])

    folders = spark.createDataFrame([(bytearray(os.fsencode(f)), d) for d, own in ((False, alone), (True, tops)) for f in own], "folder binary, deep boolean")
    return folders.repartition(min(len(alone) + len(tops), _tasks(spark))).mapInArrow(run, "path string, length long")


def corpus(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """agreement, file, size_mb of all files in numeric folders; contents are not read. Order it by agreement and file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return _sized(_few(files.select("path", "length")))


def _sized(files: DataFrame) -> DataFrame:
    return _keyed(files, "path").select("agreement", "file", (F.col("length") / (1024 * 1024)).alias("size_mb"), F.col("length").alias("n_bytes"))


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """corpus() for any number of files: tasks list a folder on disk, where corpus() keeps each file on the driver. Files without a byte are rows too.

    What is in another store, or is not one folder, is listed by corpus().
    """
    disk = on_disk(spark, root)
    return _sized(_listed(spark, disk, pattern)) if disk is not None and os.path.isdir(disk) else corpus(spark, root, pattern)


def contents(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """agreement, file and content (binary), for extractors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return _keyed(_few(files.select("path", "content")), "path").select("agreement", "file", "content")


def texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """agreement, file and text, a whole file in each row."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    return _keyed(_few(files.select("value", F.col("_metadata.file_path").alias("path"))), "path").select("agreement", "file", F.col("value").alias("text"))


def json_values(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """agreement, file, v and kind (pages, topics or bad) of files that hold one JSON value each, over many lines or one. What a file holds is told from its value."""
    return parsed(texts(spark, root, pattern))


def parsed(found: DataFrame) -> DataFrame:
    """json_values of agreement, file and text."""
    shape = F.schema_of_variant("v")
    kind = F.when(shape.startswith("ARRAY"), "pages").when(shape.startswith("OBJECT"), "topics").otherwise("bad")
    return found.withColumn("v", F.try_parse_json("text")).withColumn("kind", F.when(F.col("v").isNull(), "bad").otherwise(kind)).select("agreement", "file", "text", "v", "kind")


def pages(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """agreement, file, page, ocr_used, text of files that hold an array of pages; a page that is only a text has its place, from 1, as number. Other files give no rows."""
    return pages_of(json_values(spark, root, pattern))


def pages_of(values: DataFrame) -> DataFrame:
    """pages of json_values."""
    found = values.where("kind = 'pages'")
    each = found.select("agreement", "file", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("at", "p"))
    bare = F.schema_of_variant("p") == "STRING"
    get = lambda name, kind: F.try_variant_get("p", f"$.{name}", kind)
    page = F.when(bare, F.col("at") + 1).otherwise(get("page", "int"))
    return each.select("agreement", "file", page.alias("page"), get("ocr_used", "boolean").alias("ocr_used"), F.when(bare, F.try_variant_get("p", "$", "string")).otherwise(get("text", "string")).alias("text"))


def topics(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """agreement, file and a map of topic to list of texts. Each topic may be a list or one text, keys any case and spacing; of keys that become the same the last in code point order counts.

    Null topics are empty lists; items that are no texts stay as JSON.
    """
    return topics_of(json_values(spark, root, pattern))


def topics_of(values: DataFrame) -> DataFrame:
    """topics of json_values."""
    found = values.where("kind = 'topics'")
    key = lambda k: F.replace(F.lower(k), F.lit(" "), F.lit("_"))
    said = lambda v: F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.to_json(v))
    items = lambda v: F.transform(F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda i: i.isNotNull() & ~F.is_variant_null(i)), said)
    value = lambda v: F.when(v.isNull() | F.is_variant_null(v), F.array().cast("array<string>")).when(F.schema_of_variant(v).startswith("ARRAY"), items(v)).otherwise(F.array(said(v)))
    entries = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))
    named = F.transform(entries, lambda e: F.struct(key(e["key"]).alias("key"), value(e["value"]).alias("value")))
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda other: other["key"] == e["key"]))
    return found.select("agreement", "file", F.map_from_entries(last).alias("topics"))


def unread(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """agreement, file, reason and text of files that hold neither pages nor topics. Files without a byte are no rows; listing() has them."""
    return unread_of(json_values(spark, root, pattern))


def unread_of(values: DataFrame) -> DataFrame:
    """unread of json_values."""
    reason = F.when(F.col("v").isNull(), "no JSON").otherwise("neither a list nor an object")
    return values.where("kind = 'bad'").select("agreement", "file", reason.alias("reason"), "text")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """The rows of JSON lines, and the lines that are none, with their file, for a table of their own. Blank lines are skipped.

    strict: a bad line is an error instead. A line with a value of another type than its field's is bad too.
    """
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path), None
    bad = "_bad_line"
    # Parsed from lines, so that every field counts for a line to be good, whichever fields are asked for later.
    lines = spark.read.text(path).where(has_text(F.col("value"))).select("value", F.col("_metadata.file_path").alias("file"))
    lines = lines.withColumn("r", F.from_json("value", f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}))
    return lines.where(F.col(f"r.{bad}").isNull()).select("r.*").drop(bad), lines.where(F.col(f"r.{bad}").isNotNull()).select("file", F.col("value").alias("line"))


def run_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Lines of a run log. A bad line is an error, or is left out; blank lines are skipped."""
    return spark.read.schema(RUN_LOG).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def names(spark: SparkSession, path: str) -> DataFrame:
    """The non-blank lines of a text file, trimmed."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "^\ufeff", "")).alias("name")).where(has_text(F.col("name")))


#: Byte order marks and the encoding that each announces.
MARKS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))
HEAD_LINES = 20


def _form(head: list[bytes]) -> tuple[str, str, bool, str]:
    """Separator, encoding, whether there is a byte order mark and header of a file with these first lines."""
    data = b"\n".join(head)
    mark, encoding = next(((m, e) for m, e in MARKS if data.startswith(m)), (b"", None))
    data = data[len(mark) :]
    if encoding is None:
        try:
            data.decode()
            encoding = ENCODINGS[0]
        except UnicodeDecodeError:
            encoding = ENCODINGS[1]
    lines = [x for x in data.decode(encoding, "replace").splitlines() if x]
    good = [s for s in SEPARATORS if lines and min(x.count(s) for x in lines) > 0]
    # A separator within quotes may be rare in the first lines: of several the one that is in every line most often.
    sep = max(good, key=lambda s: min(x.count(s) for x in lines)) if good else SEPARATORS[0]
    return sep, encoding, bool(mark), lines[0].strip("\r") if lines else ""


def forms(spark: SparkSession, path: str) -> DataFrame:
    """path, sep, encoding, marked and header of each file of a folder, told in the tasks that read their first parts."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[str, list[bytes]] = {}  # as many files as one task reads
        for batch in batches:
            for file, line in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                head = heads.setdefault(file, [])
                if len(head) < HEAD_LINES:
                    head.append(line)
        told = [(file, *_form(head)) for file, head in heads.items()]
        yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in told], k) for i, k in enumerate((pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()))], names=["path", "sep", "encoding", "marked", "header"])

    return lines.mapInArrow(run, "path string, sep string, encoding string, marked boolean, header string")


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """Separator and encoding of a table, from its first lines."""
    found = forms(spark, path).orderBy("path").first()
    return (found.sep, found.encoding) if found else (SEPARATORS[0], ENCODINGS[0])


def _csv(spark: SparkSession, paths: str | list[str], sep: str, encoding: str, marked: bool = False, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true").option("sep", sep).option("encoding", encoding).option("multiLine", "true")
    rows = (reader.schema(schema) if schema else reader).csv(paths)
    return rows.withColumnsRenamed({c: c.lstrip("\ufeff") for c in rows.columns[:1] if marked and c.startswith("\ufeff")})


def csv(spark: SparkSession, path: str, schema: str | None = None, sep: str | None = None) -> DataFrame:
    """A table with a header. Without a separator it is told from the first lines, and a byte order mark skipped; without a schema all columns are text."""
    if sep is not None:
        return _csv(spark, path, sep, ENCODINGS[0], True, schema)
    found = forms(spark, path).orderBy("path").first()
    return _csv(spark, path, found.sep, found.encoding, found.marked, schema) if found else _csv(spark, path, SEPARATORS[0], ENCODINGS[0], False, schema)


def mixed_tables(spark: SparkSession, folder: str) -> DataFrame:
    """One table of all files of a folder, each with its own separator, encoding, byte order mark and order of columns; columns that a file lacks are null.

    Files of the same form are read together by Spark, so there is one reader for each form, not each file. Empty files have no form and no rows.
    """
    groups = forms(spark, folder).where("header <> ''").groupBy("sep", "encoding", "marked", "header").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header", "sep", "encoding", "marked")
    out = None
    for g in groups.collect():  # the driver lists a folder's files for any reader
        rows = _csv(spark, list(g.paths), g.sep, g.encoding, g.marked)
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no table in {folder}")
    return out


def table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reads by suffix: Parquet, JSON lines, separated text or a workbook (its first sheet, or the one named as sheet)."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix in ("json", "jsonl"):
        return spark.read.json(path)
    if suffix in ("csv", "txt", "tsv"):
        return csv(spark, path, **options)
    if suffix == "xlsx":
        return workbooks.table(spark, path, **options)
    raise ValueError(f"no reader for .{suffix}")


def flagged_keys(rows: DataFrame, flag: str, key: str, wanted: str = "Yes") -> DataFrame:
    """The whole numbers of key where flag says so."""
    return rows.where(F.col(flag) == wanted).select(F.col(key).try_cast("int").alias(key)).dropna()


def promoted_header(rows: DataFrame, order: str) -> DataFrame:
    """A table whose first row holds the names: that row becomes the header. One row is read on the driver."""
    first = rows.orderBy(order).first()
    names_ = [c for c in rows.columns if c != order]
    header = {c: str(first[c]).strip() for c in names_ if first is not None and first[c] is not None}
    return rows.where(F.col(order) != first[order]).select(order, *(F.col(c).alias(header[c]) for c in header)) if first is not None else rows


def listed_files(files: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files that are not done yet."""
    return files.join(done.select(*keys).distinct(), list(keys), "left_anti")
