"""Queries over files: tables are written in the forms that a corpus comes in, and read back by the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans.tables import table
from ledgerloom.sources import extractors, files, sinks, workbooks
from ledgerloom.storage import new_path


_one_file_each = sinks.one_file_each


def json_documents(s, d):
    """Conversations as files: some an array of pages, some an object of topics whose values are lists or single texts, some damaged."""
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    pages = F.transform("t", lambda x: F.struct(x["turn"].alias("page"), (x["role"] == "user").alias("ocr_used"), x["text"].alias("text")))
    of = lambda role: F.transform(F.filter("t", lambda x: x["role"] == role), lambda x: x["text"])
    first = F.get(F.transform("t", lambda x: x["text"]), F.lit(0))
    topics = F.struct(of("user").alias("User Information"), of("assistant").alias("assistant"), first.alias("FIRST text"))
    pretty = {"pretty": "true"}
    whole = F.when(F.col("conv_id") % 2 == 0, F.to_json(pages, pretty)).otherwise(F.to_json(topics, pretty))
    told = c.select("conv_id", F.when(F.col("conv_id") % 7 == 3, F.left(whole, F.length(whole) - 1)).otherwise(whole).alias("json"))
    root = new_path(s, "json-documents")
    _one_file_each(told, root, "conv_id", "json")
    out = lambda kind, name, item, text: (F.col("agreement").cast("long").alias("conv_id"), F.lit(kind).alias("kind"), name.alias("name"), item.cast("long").alias("item"), F.md5(text).alias("text"))
    none = F.lit(None).cast("string")
    held = new_path(s, "json-documents-read")  # the files are listed and read once
    files.texts(s, root, "*.txt").write.parquet(held)
    values = files.parsed(s.read.parquet(held))
    found = files.pages_of(values).select(*out("page", F.when(F.col("ocr_used"), "user").otherwise("other"), F.col("page"), F.col("text")))
    listed = files.topics_of(values).select("agreement", F.explode("topics").alias("topic", "texts")).select("agreement", "topic", F.posexplode("texts").alias("item", "text"))
    return found.unionByName(listed.select(*out("topic", F.col("topic"), F.col("item"), F.col("text")))).unionByName(files.unread_of(values).select(*out("bad", F.col("reason"), F.lit(None), none)))


JSON_DOCUMENTS = """WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations), good AS (SELECT * FROM c WHERE conv_id % 7 <> 3)
SELECT conv_id, 'page' AS kind, CASE WHEN role = 'user' THEN 'user' ELSE 'other' END AS name, turn AS item, md5(text) AS text FROM good WHERE conv_id % 2 = 0
UNION ALL SELECT conv_id, 'topic', CASE role WHEN 'user' THEN 'user_information' ELSE role END, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) - 1, md5(text) FROM good WHERE conv_id % 2 = 1 AND role IN ('user', 'assistant')
UNION ALL SELECT conv_id, 'topic', 'first_text', 0, md5(arg_min(text, turn)) FROM good WHERE conv_id % 2 = 1 GROUP BY 1
UNION ALL SELECT DISTINCT conv_id, 'bad', 'no JSON', NULL::BIGINT, NULL FROM c WHERE conv_id % 7 = 3"""


def json_lines(s, d):
    """Events as JSON lines, some of them cut short and some with a text for a number: what is read by type, and how many lines are set apart."""
    path, apart = new_path(s, "json-lines"), new_path(s, "json-lines-bad")
    own = F.to_json(F.struct("event_id", "event_type", "value"))
    k = F.col("event_id") % 11
    line = F.when(k == 5, F.left(own, F.length(own) - 2)).when(k == 7, F.replace(own, F.lit('"value":'), F.lit('"value":"none", "was":'))).otherwise(own)
    table(s, d, "events").select(line.alias("line")).write.text(path)
    good, bad = files.json_lines(s, path, "event_id long, event_type string, value double", strict=False)
    bad.write.parquet(apart)
    found = good.groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))
    return found.crossJoin(F.broadcast(s.read.parquet(apart).agg(F.count("*").alias("bad_lines"))))  # a single row


JSON_LINES = """SELECT event_type, count(*) AS events, round(sum(value), 2) AS total, (SELECT count(*) FROM events WHERE event_id % 11 IN (5, 7)) AS bad_lines FROM events WHERE event_id % 11 NOT IN (5, 7) GROUP BY 1"""


def corpus_listing(s, d):
    """Documents as files in numbered folders: how many each folder holds and their bytes, folders in order of their numbers."""
    root = new_path(s, "corpus")
    docs = table(s, d, "documents").select((F.col("doc_id") % 12 * 9).alias("folder"), F.coalesce("text", F.lit("")).alias("text"))
    _one_file_each(docs, root, "folder", "text")
    held = new_path(s, "corpus-listed")  # the folders are listed once
    files.listing(s, root).groupBy("agreement").agg(F.count("*").alias("files"), F.sum("n_bytes").alias("n_bytes"), F.round(F.sum("size_mb"), 6).alias("size_mb")).write.parquet(held)
    found = s.read.parquet(held)
    lower = found.select(F.col("agreement").alias("other"))
    before = found.join(F.broadcast(lower), F.col("other") < F.col("agreement"), "left").groupBy("agreement", "files", "n_bytes", "size_mb")  # a row a folder of 12
    return before.agg((F.count("other") + 1).alias("place"))


CORPUS_LISTING = """WITH f AS (SELECT CAST(doc_id % 12 * 9 AS INTEGER) AS agreement, octet_length(encode(coalesce(text, ''))) + 1 AS n FROM documents)
SELECT agreement, count(*) AS files, CAST(sum(n) AS BIGINT) AS n_bytes, round(sum(n) / 1048576.0::DOUBLE, 6) AS size_mb, rank() OVER (ORDER BY agreement) AS place FROM f GROUP BY 1"""


def mixed_tables(s, d):
    """Customers in files of four forms in one folder: separators, encodings, byte order marks and orders of columns differ."""
    folder = new_path(s, "mixed-tables")
    rows = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), F.concat("c_name", F.lit(" é;x")).alias("c_name"), F.col("c_nationkey").cast("string").alias("c_nationkey"))
    forms = ((";", "UTF-8", ""), (",", "UTF-8", "﻿"), ("\t", "ISO-8859-1", ""), (",", "UTF-16LE", "﻿"))
    for n, (sep, encoding, mark) in enumerate(forms):
        own = rows.where(F.col("c_custkey") % 4 == n)
        own = own.select("c_nationkey", "c_name", "c_custkey") if n == 2 else own
        own.toDF(mark + own.columns[0], *own.columns[1:]).coalesce(1).write.mode("append").option("header", "true").option("sep", sep).option("encoding", encoding).option("quoteAll", n == 0).csv(folder)
    return files.mixed_tables(s, folder).select("c_custkey", "c_name", "c_nationkey")


MIXED_TABLES = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ' é;x' AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer"""


def replaced_partitions(s, d):
    """Events by type and half of the users; the partitions of one half are rewritten with other values, the others stay."""
    path = new_path(s, "replaced")
    rows = table(s, d, "events").select("event_id", "value", "event_type", (F.col("user_id") % 2).cast("int").alias("half"))
    sinks.replace_partitions(rows, path, ["half", "event_type"])
    sinks.replace_partitions(rows.where("half = 1 and event_type <> 'click'").withColumn("value", -F.col("value")), path, ["half", "event_type"])
    return s.read.parquet(path).select("event_id", "event_type", "half", "value")


REPLACED = """SELECT event_id, event_type, CAST(user_id % 2 AS INTEGER) AS half, CASE WHEN user_id % 2 = 1 AND event_type <> 'click' THEN -value ELSE value END AS value FROM events"""

def workbook_sheets(s, d):
    """Suppliers, nations and regions as three sheets of one workbook, read back sheet by sheet and joined."""
    path = f"{new_path(s, 'workbook')}/tables.xlsx"
    own = {n: table(s, d, n) for n in ("region", "nation", "supplier")}
    own["supplier"] = own["supplier"].select("s_suppkey", F.concat(F.lit(' <"é"> & '), "s_name").alias("s_name"), "s_nationkey", (F.col("s_suppkey") % 2 == 0).alias("even"), "s_acctbal")
    workbooks.write(s, own, path, {"supplier": ["s_suppkey"]})
    supplier, nation, region = (workbooks.table(s, path, n) for n in ("supplier", "nation", "region"))
    named = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    return supplier.join(named, supplier["s_nationkey"] == named["n_nationkey"]).select("s_suppkey", "s_name", "even", F.col("s_acctbal").cast("double").alias("s_acctbal"), "n_name", "r_name")


WORKBOOK = """SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, ' <"é"> & ' || s_name AS s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS even, s_acctbal::DOUBLE AS s_acctbal, n_name, r_name
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

def extracted_lines(s, d):
    """The lines of all documents by topic, as the default extractor's table function finds them."""
    extractors.register(s)
    table(s, d, "documents").createOrReplaceTempView("documents_to_extract")
    return s.sql("SELECT doc_id, topic, item, md5(line) AS line, error_message FROM documents_to_extract, LATERAL extracted_topics(text, 'keywords')")


EXTRACTED = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents),
t AS (SELECT doc_id, place, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM l),
n AS (SELECT *, CASE {' '.join("WHEN " + " OR ".join(f"contains(lower(line), '{w}')" for w in words) + f" THEN '{topic}'" for topic, words in extractors.TOPIC_WORDS.items())} ELSE 'general' END AS topic FROM t WHERE line <> '')
SELECT doc_id, topic, CAST(row_number() OVER (PARTITION BY doc_id, topic ORDER BY place) - 1 AS INTEGER) AS item, md5(line) AS line, NULL::VARCHAR AS error_message FROM n"""

def text_report(s, d):
    """A report of documents by language and of the emptiest sources, written as text and read back line by line."""
    docs = table(s, d, "documents").select("lang", "source", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    by = lambda c: docs.groupBy(c).agg(F.count("*").alias("documents"), F.sum("n").alias("characters"), F.round(100 * F.avg((F.col("n") > 500).cast("double")), 6).alias("long"))
    few = by("source").where("long < 0")
    lines = sinks.report_lines([
        ("DOCUMENTS BY LANGUAGE", by("lang"), "%-8s %8d documents, %12d characters, %6.1f%% long", ["lang", "documents", "characters", "long"], ["lang"]),
        ("SOURCES", by("source"), "- %s: %d", ["source", "documents"], ["documents", "source"]),
        ("SOURCES WITHOUT LONG DOCUMENTS", few, "- %s", ["source"], ["source"]),
    ])
    path = new_path(s, "report")
    sinks.write_report(lines, path)
    return s.read.text(path).where("value <> ''").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


TEXT_REPORT = """WITH d AS (SELECT lang, source, length(coalesce(text, '')) AS n FROM documents), l AS (SELECT coalesce(lang, '-') AS k, count(*) AS c, sum(n) AS s, round(100 * avg(CASE WHEN n > 500 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p FROM d GROUP BY lang),
t AS (SELECT printf('%-8s %8d documents, %12d characters, %6.1f%% long', k, c::BIGINT, s::BIGINT, p) AS line FROM l UNION ALL SELECT printf('- %s: %d', coalesce(source, '-'), count(*)::BIGINT) FROM d GROUP BY source
 UNION ALL SELECT unnest(['DOCUMENTS BY LANGUAGE', repeat('-', 21), 'SOURCES', '-------', 'SOURCES WITHOUT LONG DOCUMENTS', repeat('-', 30), '(none)']))
SELECT line, count(*) AS n FROM t GROUP BY 1"""

QUERIES = {"text_report": text_report, "extracted_lines": extracted_lines, "workbook_sheets": workbook_sheets, "json_documents": json_documents, "json_lines": json_lines, "corpus_listing": corpus_listing, "mixed_tables": mixed_tables, "replaced_partitions": replaced_partitions}
ORACLES = {"text_report": TEXT_REPORT, "extracted_lines": EXTRACTED, "workbook_sheets": WORKBOOK, "json_documents": JSON_DOCUMENTS, "json_lines": JSON_LINES, "corpus_listing": CORPUS_LISTING, "mixed_tables": MIXED_TABLES, "replaced_partitions": REPLACED}
