"""Queries over documents and topics: comparison, screening, records, markdown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import compare as C
from ledgerloom.operators import records as R
from ledgerloom.operators import screening as S
from ledgerloom.plans.scalars import W, in_list
from ledgerloom.plans.tables import table


def neighbours(s, d):
    """Each document with the one whose id is next."""
    docs = table(s, d, "documents").select("doc_id", "text")
    return docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")


#: Parts that a task's share of documents is dealt into, so that a part is as large whatever the input.
DEALT = 16


def _dealt(rows, docs, key: str):
    """rows by key in a number of parts that grows with the input of docs."""
    return rows.repartition(DEALT * docs.rdd.getNumPartitions(), key)


def similarity(s, d):
    """Each document against the next: what is compared is taken from each text once, and only that is brought together, lists as single texts."""
    t, docs = F.col("text"), table(s, d, "documents").select("doc_id", "text")
    one = docs.select("doc_id", F.array_join(T.characters(t), "").alias("characters"), F.array_join(T.key_terms(t), " ").alias("terms"), F.array_join(F.array_distinct(T.words(t)), " ").alias("words"), (F.length(t) == 0).alias("none"))
    sides = one.select(F.explode(F.array(F.struct(F.col("doc_id").alias("pair"), F.lit("a").alias("side")), F.struct((F.col("doc_id") - 1).alias("pair"), F.lit("b").alias("side")))).alias("at"), F.struct("characters", "terms", "words", "none").alias("of"))
    sides = _dealt(sides.select("at.*", "of"), docs, "pair")
    held = lambda x: F.first(F.when(F.col("side") == x, F.col("of")), ignorenulls=True).alias(x)
    both = sides.groupBy(F.col("pair").alias("doc_id")).agg(held("a"), held("b")).where("a is not null and b is not null")
    listed = lambda side, part, by: F.filter(F.split(F.col(f"{side}.{part}"), by), lambda x: x != "").alias(part)
    whole = lambda side: F.struct(listed(side, "characters", ""), listed(side, "terms", " "), listed(side, "words", " "), F.col(f"{side}.none").alias("none")).alias(side)
    both = both.select("doc_id", whole("a"), whole("b"))
    terms = F.when(F.col("a.none") & F.col("b.none"), 1.0).when(F.col("a.none") | F.col("b.none"), 0.0).otherwise(T.jaccard(F.col("a.terms"), F.col("b.terms")))
    rows = both.select("doc_id", T.jaccard(F.col("a.characters"), F.col("b.characters")).alias("characters"), terms.alias("terms"), F.size(F.array_except("a.words", "b.words")).cast("long").alias("only_here"))
    return rows.withColumns({"characters": F.round("characters", 6), "terms": F.round("terms", 6)}).withColumn("alike", (F.col("characters") >= 0.8) & (F.col("terms") >= 0.6))


def distinct_words(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '{W}+'))"


def meaning_words(c: str) -> str:
    words = rf"string_split(regexp_replace(lower({c}), '[^{W[1:-1]}]+', ' ', 'g'), ' ')"
    return f"list_distinct(list_filter({words}, lambda w: length(w) > 3 AND NOT list_contains({in_list(T.FILLER_WORDS + T.STOP_WORDS)}, w)))"


SIMILARITY = f"""WITH p AS (SELECT a.doc_id, a.text, b.text AS other FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
l AS (SELECT doc_id, list_distinct(string_split(lower(text), '')) AS ca, list_distinct(string_split(lower(other), '')) AS cb, {meaning_words('text')} AS ma, {meaning_words('other')} AS mb, {distinct_words('text')} AS wa, {distinct_words('other')} AS wb FROM p),
j AS (SELECT doc_id, round(len(list_intersect(ca, cb)) / len(list_distinct(list_concat(ca, cb))), 6) AS characters, CASE WHEN len(ma) = 0 AND len(mb) = 0 THEN 1.0 WHEN len(ma) = 0 OR len(mb) = 0 THEN 0.0 ELSE round(len(list_intersect(ma, mb)) / len(list_distinct(list_concat(ma, mb))), 6) END AS terms,
 len(wa) - len(list_intersect(wa, wb)) AS only_here FROM l) SELECT *, characters >= 0.8 AND terms >= 0.6 AS alike FROM j"""


def screened(s, d):
    rows = neighbours(s, d).select("doc_id", F.array_join(S.quick_issues(F.col("text"), F.col("other")), ",").alias("quick"))
    return rows.groupBy("quick").agg(F.count("*").alias("n"))


SCREENED = rf"""WITH p AS (SELECT a.text AS a, b.text AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
f AS (SELECT array_to_string(list_filter([CASE WHEN length(a) > 0 AND length(b) > 0 AND abs(length(a) - length(b)) / greatest(length(a), length(b)) > 0.15 THEN 'text difference' END,
 CASE WHEN len(list_filter(string_split(b, chr(10)), lambda l: length(regexp_replace(l, '^\s+|\s+$', '', 'g')) > 150)) > 0 THEN 'long lines' END,
 CASE WHEN len(list_filter({in_list(S.NOTE_WORDS)}, lambda k: contains(lower(b), k))) > 0 THEN 'annotations' END,
 CASE WHEN len(list_filter({in_list(S.LEGAL_TERMS)}, lambda k: contains(lower(b), k))) > 3 THEN 'legal terms' END], lambda x: x IS NOT NULL), ',') AS quick FROM p) SELECT quick, count(*) AS n FROM f GROUP BY 1"""


def hidden(s, d):
    """Signs of hidden text: of each document, the next one as layout, and the text without its last half as recognised text."""
    ocr = F.when(F.col("doc_id") % 10 == 0, "ERROR: none").otherwise(F.array_join(F.slice(F.split("text", " "), F.lit(1), F.ceil(F.size(F.split("text", " ")) / 2).cast("int")), " "))
    docs = table(s, d, "documents").select("doc_id", "text")
    own = _dealt(docs.select("doc_id", S.native_signs(F.col("text"), ocr).alias("own")), docs, "doc_id")
    after = _dealt(docs.select((F.col("doc_id") - 1).alias("doc_id"), S.layout_signs(F.col("text")).alias("layout")), docs, "doc_id")
    issues = own.join(after, "doc_id").select(S.hidden_flags(F.col("own"), F.col("layout")).alias("issues")).select(F.explode("issues").alias("issue"))
    return issues.groupBy("issue").agg(F.count("*").alias("n"))


HIDDEN = rf"""WITH p AS (SELECT a.doc_id, CASE WHEN starts_with(a.text, 'ERROR') THEN '' ELSE coalesce(a.text, '') END AS na, CASE WHEN starts_with(b.text, 'ERROR') THEN '' ELSE coalesce(b.text, '') END AS la,
 CASE WHEN a.doc_id % 10 = 0 THEN '' ELSE array_to_string(string_split(a.text, ' ')[1:CAST(ceil(len(string_split(a.text, ' ')) / 2) AS INTEGER)], ' ') END AS r FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
o AS (SELECT na, la, CASE WHEN starts_with(r, 'ERROR') THEN '' ELSE r END AS oc, list_transform(string_split(la, chr(10)), lambda l: length(regexp_replace(l, '^\s+|\s+$', '', 'g')) > 200) AS long FROM p),
w AS (SELECT *, length(na) AS a, length(la) AS b, length(oc) AS c, regexp_extract_all(lower(na), '{W}+') AS n1, regexp_extract_all(lower(oc), '{W}+') AS o1, {distinct_words('na')} AS wa, {distinct_words('la')} AS wb, {distinct_words('oc')} AS wc, list_position(long, true) AS pos FROM o),
x AS (SELECT *, CASE WHEN pos > 0 THEN string_split(la, chr(10))[1:pos - 1] ELSE string_split(la, chr(10)) END AS seen, len(n1) / nullif(len(o1), 0)::DOUBLE AS q FROM w),
f AS (SELECT unnest([CASE WHEN a > 0 AND b > 0 AND abs(a - b) / greatest(a, b)::DOUBLE > 0.2 THEN 'methods differ' END, CASE WHEN a > 0 AND c > 0 AND c / a::DOUBLE > 1.5 THEN 'more recognised' END, CASE WHEN b > a * 1.3 THEN 'more in layout' END,
 CASE WHEN pos > 0 THEN 'long line' END, CASE WHEN len(list_filter(seen, lambda l: len(list_filter({in_list(S.HIDDEN_WORDS)}, lambda k: contains(lower(l), k))) > 0)) > 0 THEN 'annotation' END,
 CASE WHEN c > 0 AND len(list_filter(wc, lambda v: NOT list_contains(wa, v) AND NOT list_contains(wb, v))) > 10 THEN 'only recognised' END, CASE WHEN a > 0 AND c > 0 AND len(wa) - len(list_intersect(wa, wc)) > 10 THEN 'only native' END,
 CASE WHEN a > 0 AND c > 0 AND len(wb) - len(list_intersect(wb, wc)) > 10 THEN 'only layout' END, CASE WHEN q > 1.3 THEN 'more words native' END, CASE WHEN q < 0.7 AND q > 0 THEN 'more words recognised' END]) AS issue FROM x)
SELECT issue, count(*) AS n FROM f WHERE issue IS NOT NULL GROUP BY 1"""


def pages(s, d):
    """Conversations as documents of pages: which text a page gets."""
    c = table(s, d, "conversations")
    images, ocr = F.col("turn") % 3 == 0, F.when(F.col("turn") % 4 != 0, F.replace("text", F.lit("e"), F.lit("c")))
    native = F.when(F.col("turn") % 5 == 2, "").otherwise(F.col("text"))
    found, used = S.page_text(images, native, ocr)
    return c.select("conv_id", F.col("turn").alias("page"), found.alias("text"), used.alias("ocr_used"))


PAGES = """p AS (SELECT conv_id, turn AS page, turn % 3 = 0 OR turn % 5 = 2 OR text = '' AS reads, turn % 4 <> 0 AS can, text AS t FROM conversations),
q AS (SELECT conv_id, page, CASE WHEN reads THEN CASE WHEN can AND trim(t) <> '' THEN trim(replace(t, 'e', 'c')) ELSE '[EMPTY PAGE]' END ELSE t END AS text, reads AND can AS ocr_used FROM p)"""


def markdown(s, d):
    rows = R.markdown_document(pages(s, d), "conv_id", "page", "text", "ocr_used", "Document")
    return rows.select("conv_id", F.md5("markdown").alias("markdown"), F.length("markdown").cast("long").alias("size"))


MARKDOWN = rf"""WITH {PAGES}, b AS (SELECT conv_id, page, '## Page ' || page || chr(10) || CASE WHEN ocr_used THEN '*[Text extracted using OCR]*' || chr(10) ELSE '' END || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) AS x FROM q),
m AS (SELECT conv_id, '# Document' || chr(10) || '*Converted from: ' || conv_id || '*' || chr(10) || '---' || chr(10) || string_agg(x, '' ORDER BY page) AS m FROM b GROUP BY 1) SELECT conv_id, md5(m) AS markdown, length(m) AS size FROM m"""


def lists(s, d):
    """Each conversation's turns as a list, and the same list changed in one of six ways."""
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("a"))
    k = F.col("conv_id") % 6
    b = (
        F.when(k == 0, F.col("a"))
        .when(k == 1, F.reverse("a"))
        .when(k == 2, F.array_append(F.transform("a", lambda x: F.replace(x, F.lit(" "), F.lit("  "))), F.lit("")))
        .when(k == 3, F.transform("a", lambda x: F.concat(F.replace(x, F.lit("."), F.lit("!")), F.lit(" the"))))
        .when(k == 4, F.transform("a", lambda x: F.concat(x, F.lit(" could now"))))
        .otherwise(F.slice("a", 1, 1))
    )
    return c.withColumn("b", b)


def matched(s, d):
    return C.all_match(C.matches(lists(s, d), ["conv_id"], "a", "b"))


def match_levels(s, d):
    rows = C.matches(lists(s, d), ["conv_id"], "a", "b").withColumn("change", (F.col("conv_id") % 6).cast("string"))
    levels = [c for c in rows.columns if c.endswith("_match")]
    return rows.groupBy("change").agg(*(F.bool_and(c).alias(c) for c in levels))


MATCH_LEVELS = """SELECT change, change = '0' AS hash_match, change = '0' AS strict_match, change IN ('0', '1') AS flexible_match, change IN ('0', '1', '2') AS very_flexible_match,
 change IN ('0', '1', '2', '3') AS fuzzy_match, change <> '5' AS meaning_match, true AS data_match FROM (SELECT DISTINCT CAST(conv_id % 6 AS VARCHAR) AS change FROM conversations)"""
ALL_MATCH = """SELECT count(DISTINCT conv_id) AS pairs, bool_and(conv_id % 6 = 0) AS hash_all, bool_and(conv_id % 6 = 0) AS strict_all, bool_and(conv_id % 6 < 2) AS flexible_all, bool_and(conv_id % 6 < 3) AS very_flexible_all,
 bool_and(conv_id % 6 < 4) AS fuzzy_all, bool_and(conv_id % 6 < 5) AS meaning_all, true AS data_all FROM conversations"""


def list_differences(s, d):
    return C.list_differences(lists(s, d), ["conv_id"], "a", "b")


LIST_DIFFERENCES = """WITH a AS (SELECT conv_id, list(text ORDER BY turn) AS a FROM conversations GROUP BY 1), p AS (SELECT conv_id, conv_id % 6 AS k, a, CASE conv_id % 6 WHEN 0 THEN a WHEN 1 THEN list_reverse(a) WHEN 2 THEN list_append(list_transform(a, lambda x: replace(x, ' ', '  ')), '')
 WHEN 3 THEN list_transform(a, lambda x: replace(x, '.', '!') || ' the') WHEN 4 THEN list_transform(a, lambda x: x || ' could now') ELSE a[:1] END AS b FROM a)
 SELECT conv_id, len(a) AS size_a, len(b) AS size_b, abs(len(a) - len(b)) AS apart, len(a) = len(b) AND len(list_distinct(a)) = len(list_distinct(b)) AND a[:5] = b[:5] AS same_profile, list_sort(list_distinct(a)) = list_sort(list_distinct(b)) AS same_items FROM p"""

COLUMNS = ["salary_1", "jobgroup", "training", "Homeoffice", "vacation_time", "start_date_contract", "expiry_date_contract"]


def items(s, d):
    c = table(s, d, "conversations")
    wages = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("salary_1"), F.when(F.col("turn") % 4 == 0, "all").alias("jobgroup"), F.lit("x").alias("unknown"))
    others = c.where("role <> 'user'").select("conv_id", "turn", F.col("text").alias("training"), F.when(F.col("turn") > 2, "25").otherwise("").alias("vacation_time"), F.when(F.col("turn") < 4, F.concat(F.lit("2020-01-0"), "turn")).alias("start_date_contract"), F.lit("").alias("expiry_date_contract"))
    return wages, others


def fan_out(s, d):
    return R.fan_out(*items(s, d), "conv_id", "turn", COLUMNS)


FAN_OUT = """WITH o AS (SELECT conv_id, turn, text AS training, CASE WHEN turn > 2 THEN '25' ELSE '' END AS vacation_time, CASE WHEN turn < 4 THEN '2020-01-0' || turn ELSE '' END AS start FROM conversations WHERE role <> 'user'),
k AS (SELECT unnest(['Pension', 'Leave', 'Termination', 'Overtime', 'Training', 'Homeoffice']) AS infotype)
SELECT conv_id, turn AS item, 'Wage' AS infotype, text AS salary_1, CASE WHEN turn % 4 = 0 THEN 'all' ELSE '' END AS jobgroup, '' AS training, '' AS "Homeoffice", '' AS vacation_time,
 coalesce((SELECT start FROM o WHERE o.conv_id = c.conv_id AND start <> '' ORDER BY turn DESC LIMIT 1), '') AS start_date_contract, '' AS expiry_date_contract FROM conversations c WHERE role = 'user'
UNION ALL SELECT conv_id, turn, infotype, '', '', CASE WHEN infotype = 'Training' THEN training ELSE '' END, '', CASE WHEN infotype = 'Leave' THEN vacation_time ELSE '' END, start, '' FROM o, k"""


def filled(s, d):
    rows = R.to_schema(fan_out(s, d).drop("start_date_contract"), ["conv_id", "item", "infotype", *COLUMNS[:5], "TTW"])
    return R.filled_rows(rows, ["conv_id", "item", "infotype"])


FILLED = f"""WITH f AS ({FAN_OUT}) SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(item AS VARCHAR) AS item, infotype, salary_1, jobgroup, training, "Homeoffice", vacation_time, '' AS "TTW" FROM f
 WHERE salary_1 NOT IN ('', 'Empty') OR jobgroup <> '' OR training NOT IN ('', 'Empty') OR vacation_time <> ''"""


def topics(s, d):
    """Topic texts of a document: each list of a role's turns joined, titled, and put one behind another."""
    c = table(s, d, "conversations")
    rows = c.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", F.array(F.col("role"), F.col("text")).alias("row")))).alias("rows"))
    lines = R.joined_lists(F.transform("rows", lambda x: x["row"]))
    texts = rows.select("conv_id", "role", *(F.when(F.col("role") == r, R.topic_text(r, lines)).alias(r) for r in ("system", "user", "assistant")))
    whole = texts.groupBy("conv_id").agg(*(F.max(r).alias(r) for r in ("system", "user", "assistant")))
    return whole.select("conv_id", F.md5(F.concat_ws("\n\n", "system", "user", "assistant")).alias("document"))


TOPICS = """WITH t AS (SELECT conv_id, role, '== ' || role || ' ==' || chr(10) || string_agg(role || ' | ' || text, chr(10) ORDER BY turn) AS x FROM conversations GROUP BY 1, 2)
SELECT conv_id, md5(string_agg(x, chr(10) || chr(10) ORDER BY CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END)) AS document FROM t GROUP BY 1"""


def table_lines(s, d):
    return R.markdown_table(table(s, d, "nation"), ["n_nationkey", "n_name"], "n_nationkey")


QUERIES = {"text_similarity": similarity, "quick_screening": screened, "hidden_text": hidden, "page_choice": pages, "markdown_documents": markdown, "markdown_table": table_lines, "all_match": matched, "match_levels": match_levels, "list_differences": list_differences, "record_fan_out": fan_out, "filled_records": filled, "topic_texts": topics}
ORACLES = {
    "text_similarity": SIMILARITY,
    "quick_screening": SCREENED,
    "page_choice": f"WITH {PAGES} SELECT * FROM q",
    "markdown_documents": MARKDOWN,
    "markdown_table": "SELECT -2 AS n, '| n_nationkey | n_name |' AS line UNION ALL SELECT -1, '| --- | --- |' UNION ALL SELECT n_nationkey, '| ' || n_nationkey || ' | ' || trim(n_name) || ' |' FROM nation",
    "match_levels": MATCH_LEVELS,
    "all_match": ALL_MATCH,
    "hidden_text": HIDDEN,
    "list_differences": LIST_DIFFERENCES,
    "record_fan_out": FAN_OUT,
    "filled_records": FILLED,
    "topic_texts": TOPICS,
}
