"""Queries over single values: texts, dates, numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import dates, missing, numbers, text
from ledgerloom.operators.compare import MONEY, PERCENT
from ledgerloom.plans.tables import table

W = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def in_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def normalised(s, d):
    t = F.col("text")
    return table(s, d, "documents").select(
        "doc_id",
        F.md5(text.collapse(t)).alias("collapsed"),
        F.md5(text.fuzzy(t)).alias("fuzzy"),
        F.md5(text.meaning(t)).alias("meaning"),
        F.md5(text.data_only(t)).alias("data_only"),
        F.md5(text.drop_controls(t)).alias("no_controls"),
        F.md5(t).alias("file_hash"),
        F.octet_length(t).cast("long").alias("n_bytes"),
        F.length(t).cast("long").alias("n_characters"),
        F.size(F.array_distinct(text.words(t))).cast("long").alias("n_words"),
        F.size(text.long_lines(t, 150)).cast("long").alias("n_long_lines"),
        numbers.estimated_tokens(t).cast("long").alias("tokens"),
        F.left(t, F.lit(50)).alias("preview"),
    )


NORMALISED = rf"""SELECT doc_id, md5({COLLAPSE.format('text')}) AS collapsed,
 md5(array_to_string(list_filter(string_split({COLLAPSE.format(f"regexp_replace(lower(text), '[^{W[1:-1]}\\s]', '', 'g')")}, ' '), lambda w: NOT list_contains({in_list(text.FILLER_WORDS)}, w)), ' ')) AS fuzzy,
 md5(array_to_string(list_filter(string_split({COLLAPSE.format(f"regexp_replace(lower(text), '[^{W[1:-1]}\\s]', ' ', 'g')")}, ' '), lambda w: length(w) > 2 AND NOT list_contains({in_list(text.FILLER_WORDS + text.STOP_WORDS)}, w)), ' ')) AS meaning,
 md5(CASE WHEN regexp_matches(text, '[0-9]') OR len(list_filter({in_list(text.KEY_INDICATORS)}, lambda k: contains(lower(text), k))) > 0
  THEN regexp_replace(lower(text), '^\s+|\s+$', '', 'g') ELSE '' END) AS data_only,
 md5(regexp_replace(text, '[\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g')) AS no_controls, md5(text) AS file_hash, strlen(text) AS n_bytes, length(text) AS n_characters,
 len(list_distinct(regexp_extract_all(lower(text), '{W}+'))) AS n_words,
 len(list_filter(string_split(text, chr(10)), lambda l: length(regexp_replace(l, '^\s+|\s+$', '', 'g')) > 150)) AS n_long_lines,
 CAST(floor(length(text) / 4) AS BIGINT) AS tokens, text[:50] AS preview FROM documents"""


def glyphs(s, d):
    docs = table(s, d, "documents")
    coded = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", "e(?![0-9])", "/G101")).otherwise(F.replace("text", F.lit("e"), F.lit("/uni0065/")))
    rows = docs.select("doc_id", coded.alias("coded"))
    t = F.col("coded")
    plain = F.when(F.col("doc_id") % 2 == 0, text.decode_glyphs(t)).otherwise(text.decode_uni(t))
    return rows.select("doc_id", text.count_matches(t, text.UNI).cast("long").alias("uni"), text.count_matches(t, text.GLYPH).cast("long").alias("glyphs"), F.md5(text.clean_slashes(plain)).alias("plain"))


#: Without any decoding: each e of the text, comes back as itself; one before a digit is left uncoded for even ids.
GLYPHS = rf"""WITH l AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '\n', chr(10)), '/\s*\n', chr(10), 'g'), '/\s*\z', '', 'g'),
 '({W}+)/({W}+)', '\1\2', 'g'), ' +', ' ', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE len(regexp_extract_all(text, 'e')) END AS uni,
 CASE WHEN doc_id % 2 = 0 THEN len(regexp_extract_all(text, 'e')) - len(regexp_extract_all(text, 'e[0-9]')) ELSE 0 END AS glyphs,
 md5(array_to_string(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10))) AS plain FROM l"""


def names(s, d):
    rows = table(s, d, "part").select("p_partkey", F.concat(F.lit(" "), F.upper("p_name"), F.lit("_-"), F.col("p_brand"), F.lit(".x.PDF")).alias("n"))
    n = F.col("n")
    return rows.select("p_partkey", text.column_name(n).alias("column_name"), text.file_key(n).alias("file_key"), text.lookup_key(n).alias("lookup_key"), text.stem(n).alias("stem"), n.rlike(r"^\s[A-Z]+[\s\-]").alias("prefixed"), F.concat(text.lookup_key(n), F.lit("_"), F.col("p_partkey")).alias("joint_key"))


NAMES = r"""WITH v AS (SELECT p_partkey, ' ' || upper(p_name) || '_-' || p_brand || '.x.PDF' AS n FROM part), k AS (SELECT *, lower(replace(replace(replace(n, ' ', ''), '-', ''), '_', '')) AS l FROM v)
SELECT p_partkey, trim(replace(lower(trim(n)), '_', ' ')) AS column_name, regexp_replace(regexp_replace(lower(n), '\.[^.]+$', ''), '[^a-z0-9]', '', 'g') AS file_key, l AS lookup_key,
 regexp_replace(n, '\.[^./]+$', '') AS stem, regexp_matches(n, '^\s[A-Z]+[\s\-]') AS prefixed, l || '_' || p_partkey AS joint_key FROM k"""


def urls(s, d):
    u = F.col("url")
    coded = F.concat(F.replace(u, F.lit("/"), F.lit("%2F")), F.lit("  a+b"))
    return table(s, d, "pages").select("page_id", text.url_basename(u).alias("basename"), text.safe_file_name(coded).alias("file_name"), text.safe_file_name(F.concat(u, F.lit("%zz"))).alias("bad_escape"))


URLS = r"""SELECT page_id, string_split(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/')[-1] AS basename,
 trim(regexp_replace(regexp_replace(url || '  a+b', '[<>:"/\\|?*]', '', 'g'), '\s+', ' ', 'g')) AS file_name,
 trim(regexp_replace(regexp_replace(url || '%zz', '[<>:"/\\|?*]', '', 'g'), '\s+', ' ', 'g')) AS bad_escape FROM pages"""


def json_texts(s, d):
    rows = table(s, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    coded = (
        F.when(k % 5 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(k % 5 == 1, F.concat(F.lit("Result: "), F.replace("props", F.lit("}"), F.lit(", }")), F.lit(" end")))
        .when(k % 5 == 2, F.concat(F.lit('{"list": [1, '), k, F.lit('], "cut": [2')))
        .when(k % 5 == 3, F.lit("no json at all"))
        .otherwise(F.col("props"))
    )
    repaired = F.try_parse_json(text.repair_json(coded, ["list"]))
    kind = F.when(F.try_variant_get(repaired, "$.k", "int").isNotNull(), "object").when(F.try_variant_get(repaired, "$.list[1]", "int").isNotNull(), "rebuilt").otherwise("text")
    found = F.coalesce(F.try_variant_get(repaired, "$.k", "int"), F.try_variant_get(repaired, "$.list[1]", "int"))
    return rows.select("event_id", kind.alias("kind"), found.alias("k"), F.try_variant_get(repaired, "$.text", "string").alias("text"))


JSON_TEXTS = """WITH v AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, CASE k % 5 WHEN 2 THEN 'rebuilt' WHEN 3 THEN 'text' ELSE 'object' END AS kind, CASE WHEN k % 5 = 3 THEN NULL ELSE k END AS k,
 CASE WHEN k % 5 = 3 THEN 'no json at all' END AS text FROM v"""

JSON_VALUES = ('null', '""', '"  "', '"Empty"', '"NONE"', '" none"', "[]", "{}", "[1]", '{"a": 1}', "0", "false", '"x"', "[[]]", "1.5", "not json")
JSON_EMPTY = (True, True, True, True, True, False, True, True, False, False, False, False, False, False, False, True)


def json_emptiness(s, d):
    value = F.element_at(F.array(*map(F.lit, JSON_VALUES)), (F.col("event_id") % len(JSON_VALUES) + 1).cast("int"))
    rows = table(s, d, "events").select("event_type", value.alias("value"))
    return rows.groupBy("event_type", "value").agg(F.count("*").alias("n"), F.count_if(missing.is_json_empty(F.col("value"))).alias("n_empty"))


JSON_EMPTINESS = f"""WITH v AS (SELECT event_type, CAST(event_id % {len(JSON_VALUES)} AS INTEGER) + 1 AS i FROM events)
SELECT event_type, {in_list(JSON_VALUES)}[i] AS value, count(*) AS n, count(*) FILTER ([{', '.join(map(str, JSON_EMPTY))}][i]) AS n_empty FROM v GROUP BY event_type, i"""


def dated(s, d):
    """Orders told as text: a start and an end date after labels, in one of five forms, an amount and a percentage."""
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    form = lambda x: F.when(k % 5 == 0, F.date_format(x, "dd-MM-yyyy")).when(k % 5 == 1, F.date_format(x, "dd/MM/yyyy")).when(k % 5 == 2, F.date_format(x, "dd.MM.yyyy")).when(k % 5 == 3, F.date_format(x, "yyyy-MM-dd")).otherwise(F.date_format(x, "dd-MM-yy"))
    notice = F.when(k % 3 == 0, F.concat(F.lit(" KVO datum: "), form(F.date_add(day, 60)))).when(k % 3 == 1, F.concat(F.lit(" datum formele kennisgeving van ontvangst "), form(F.date_add(day, 90)))).otherwise("")
    said = F.concat(F.lit("Page INGANGSDATUM: "), form(day), F.lit(" Expiratiedatum "), form(F.date_add(day, 30)), notice, F.lit(" loon € "), F.format_number(F.floor("o_totalprice"), 0), F.lit(".50 of 5.5% per "), k)
    return table(s, d, "orders").select("o_orderkey", day.alias("day"), said.alias("text"), form(day).alias("written"))


DATED = """v AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 5 AS f, floor(o_totalprice) AS p FROM orders)"""


def dates_in_text(s, d):
    t = F.col("text")
    return dated(s, d).select(
        "o_orderkey",
        dates.labelled(t, "Ingangsdatum").alias("started"),
        dates.labelled(t, "Expiratiedatum").alias("ended"),
        dates.notified(t).alias("told"),
        dates.iso_or_same(F.col("written")).alias("iso"),
        F.size(dates.all_in(t)).cast("long").alias("n_dates"),
        F.regexp_extract_all(t, F.lit(PERCENT), 1)[0].cast("double").alias("percentage"),
        F.replace(F.regexp_extract(t, MONEY, 1), F.lit(","), F.lit("")).cast("double").alias("amount"),
    )


def form(day: str) -> str:
    return f"CASE f WHEN 0 THEN strftime({day}, '%d-%m-%Y') WHEN 1 THEN strftime({day}, '%d/%m/%Y') WHEN 2 THEN strftime({day}, '%d.%m.%Y') WHEN 3 THEN strftime({day}, '%Y-%m-%d') ELSE strftime({day}, '%d-%m-%y') END"


DATES_IN_TEXT = f"""WITH {DATED} SELECT o_orderkey, {form('day')} AS started, {form('day + 30')} AS ended, CASE WHEN o_orderkey % 3 = 0 AND f < 2 THEN {form('day + 60')} WHEN o_orderkey % 3 = 1 THEN {form('day + 90')} END AS told,
 CASE WHEN o_orderkey % 5 IN (0, 1, 3) THEN strftime(day, '%Y-%m-%d') ELSE {form('day')} END AS iso, CASE WHEN o_orderkey % 5 IN (0, 1, 3) THEN CASE WHEN o_orderkey % 3 < 2 THEN 3 ELSE 2 END ELSE 0 END AS n_dates,
 5.5::DOUBLE AS percentage, p + 0.5::DOUBLE AS amount FROM v"""


def parsed_dates(s, d):
    rows = dated(s, d).withColumn("american", F.date_format("day", "MM/dd/yyyy"))
    parsed = dates.parse_column(rows, "american", "month_first")  # over half of the days are no months, so those are read month first
    return dates.parse_column(parsed, "written", "day_first").select("o_orderkey", "day_first", "month_first")


PARSED_DATES = f"WITH {DATED} SELECT o_orderkey, day AS day_first, CASE WHEN day(day) > 12 THEN day ELSE make_date(year(day), day(day), month(day)) END AS month_first FROM v"


def sizes(s, d):
    rows = table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 50 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("a"), (F.col("p_size") * 100.0).alias("b"))
    a, b = F.col("a"), F.col("b")
    ratio = F.when(a > 0, b / a).otherwise(0.0)
    return rows.select("p_partkey", F.round(ratio, 6).alias("ratio"), numbers.ratio_class(ratio).alias("size_class"), F.round(numbers.relative_difference(a, b), 6).alias("difference"), numbers.retry_seconds(a / 1000, F.col("p_partkey") % 4).alias("wait"), numbers.page_tokens(a / 1000).alias("tokens"), numbers.time_limit(a / 200).alias("time_limit"), F.round(numbers.share(a, b), 6).alias("share"), numbers.half_even(b / 8, 0).alias("half_even"))


SIZES = """WITH v AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 0.0::DOUBLE ELSE p_retailprice END AS a, p_size * 100.0::DOUBLE AS b FROM part), r AS (SELECT *, CASE WHEN a > 0 THEN b / a ELSE 0 END AS q FROM v)
SELECT p_partkey, round(q, 6) AS ratio, CASE WHEN q > 2 THEN 'large' WHEN q = 0 THEN NULL WHEN q < 0.5 THEN 'small' ELSE 'similar' END AS size_class, round(abs(a - b) / greatest(a, b), 6) AS difference,
 CAST(floor((floor(a / 1000 * 1024 * 1024 / 4) / 125000::DOUBLE * pow(2, p_partkey % 4) + 1 + p_partkey % 4) * 60) AS BIGINT) AS wait, CAST(floor(a / 1000 * 1024 / 50) AS BIGINT) * 258 AS tokens,
 CASE WHEN a / 200 > 8 THEN 1200 WHEN a / 200 > 5 THEN 900 ELSE 600 END AS time_limit, round(a * 100 / b, 6) AS share, round_even(b / 8, 0) AS half_even FROM r"""


def size_ratios(s, d):
    """Mean, smallest and largest ratio, and the ratio of the sums, of pairs with both sizes."""
    rows = table(s, d, "part").select(F.col("p_retailprice").alias("a"), (F.col("p_size") * 100.0).alias("b")).where("a > 0 and b > 0")
    ratio = F.col("b") / F.col("a")
    return rows.agg(F.round(F.avg(ratio), 6).alias("mean"), F.round(F.min(ratio), 6).alias("least"), F.round(F.max(ratio), 6).alias("most"), F.round(F.sum("b") / F.sum("a"), 6).alias("overall"), F.count_if(ratio > 2).alias("large"), F.count_if(ratio < 0.5).alias("small"))


SIZE_RATIOS = """WITH v AS (SELECT p_retailprice AS a, p_size * 100.0::DOUBLE AS b FROM part WHERE p_retailprice > 0 AND p_size > 0)
SELECT round(avg(b / a), 6) AS mean, round(min(b / a), 6) AS least, round(max(b / a), 6) AS most, round(sum(b) / sum(a), 6) AS overall, count(*) FILTER (b / a > 2) AS large, count(*) FILTER (b / a < 0.5) AS small FROM v"""


def extreme_ratios(s, d):
    """The ten largest and the ten smallest ratios of a report."""
    rows = table(s, d, "part").where("p_size > 0").select("p_partkey", F.round(F.col("p_size") * 100.0 / F.col("p_retailprice"), 6).alias("ratio"))
    top = rows.orderBy(F.desc("ratio"), "p_partkey").limit(10).withColumn("end", F.lit("largest"))
    return top.unionByName(rows.orderBy("ratio", "p_partkey").limit(10).withColumn("end", F.lit("smallest")))


EXTREME_RATIOS = """WITH v AS (SELECT p_partkey, round(p_size * 100.0::DOUBLE / p_retailprice, 6) AS ratio FROM part WHERE p_size > 0)
SELECT * FROM (SELECT *, 'largest' AS "end" FROM v ORDER BY ratio DESC, p_partkey LIMIT 10) UNION ALL SELECT * FROM (SELECT *, 'smallest' AS "end" FROM v ORDER BY ratio, p_partkey LIMIT 10)"""


def stem_flags(s, d):
    """Whether a file's stem says TTW, and how it groups names of agreements; frequencies of both."""
    name = F.concat(F.col("c_name"), F.when(F.col("c_custkey") % 4 == 0, " ttw.pdf").when(F.col("c_custkey") % 4 == 1, ".TTW").otherwise(".md"))
    flag = F.when(F.contains(F.upper(text.stem(name)), F.lit("TTW")), "yes").otherwise("no")
    return table(s, d, "customer").groupBy("c_mktsegment", flag.alias("ttw")).agg(F.count("*").alias("n"))


STEM_FLAGS = """SELECT c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN 'yes' ELSE 'no' END AS ttw, count(*) AS n FROM customer GROUP BY 1, 2"""


def pattern_totals(s, d):
    """How many documents hold a pattern, and how often it stands in all of them."""
    patterns = {"long words": "[a-z]{12,}", "numbers": "[0-9]+", "addresses": "[a-z0-9.]+@[a-z0-9.]+"}
    counts = [F.struct(F.lit(n).alias("pattern"), F.regexp_count("text", F.lit(p)).alias("n")) for n, p in patterns.items()]
    rows = table(s, d, "documents").select(F.inline(F.array(*counts)))
    return rows.groupBy("pattern").agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("total"))


PATTERN_TOTALS = r"""WITH v AS (SELECT 'long words' AS pattern, len(regexp_extract_all(text, '[a-z]{12,}')) AS n FROM documents UNION ALL SELECT 'numbers', len(regexp_extract_all(text, '[0-9]+')) FROM documents
UNION ALL SELECT 'addresses', len(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+')) FROM documents) SELECT pattern, count(*) FILTER (n > 0) AS documents, sum(n) AS total FROM v GROUP BY 1"""


QUERIES = {"text_normalised": normalised, "glyph_decoding": glyphs, "name_keys": names, "url_names": urls, "json_repair": json_texts, "json_emptiness": json_emptiness, "dates_in_text": dates_in_text, "dates_by_column": parsed_dates, "size_arithmetic": sizes, "size_ratios": size_ratios, "extreme_ratios": extreme_ratios, "stem_flags": stem_flags, "pattern_totals": pattern_totals}
ORACLES = {"text_normalised": NORMALISED, "glyph_decoding": GLYPHS, "name_keys": NAMES, "url_names": URLS, "json_repair": JSON_TEXTS, "json_emptiness": JSON_EMPTINESS, "dates_in_text": DATES_IN_TEXT, "dates_by_column": PARSED_DATES, "size_arithmetic": SIZES, "size_ratios": SIZE_RATIOS, "extreme_ratios": EXTREME_RATIOS, "stem_flags": STEM_FLAGS, "pattern_totals": PATTERN_TOTALS}
