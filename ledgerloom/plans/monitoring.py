"""Queries over run logs and quality checks. Events stand for runs, conversations for kinds of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import missing
from ledgerloom.operators import dedupe as D
from ledgerloom.operators import quality as Q
from ledgerloom.operators import runlog as R
from ledgerloom.operators.screening import file_validity
from ledgerloom.plans.tables import table
from ledgerloom.streaming.incremental import windowed_progress


def log(s, d):
    e = table(s, d, "events")
    message = F.when(F.col("event_id") % 3 == 0, "Timeout: 504 after a while").when(F.col("event_id") % 3 == 1, F.concat(F.lit("Quota: 429 per"), F.when(F.col("event_id") % 2 == 0, "Day").otherwise("minute"))).otherwise("plain")
    return e.select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm").alias("timestamp"),
        F.col("user_id").cast("string").alias("filename"),
        F.col("event_type").alias("cao_number"),
        (F.col("value") / 20).alias("file_size_mb"),
        F.col("value").alias("processing_time_seconds"),
        F.get_json_object("props", "$.k").cast("long").alias("total_tokens"),
        (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", message).alias("error_message"),
    )


LOG = """e AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M') AS timestamp, CAST(user_id AS VARCHAR) AS filename, event_type AS cao_number, value / 20 AS file_size_mb, value AS processing_time_seconds,
 CAST(json_extract(props, '$.k') AS BIGINT) AS total_tokens, event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 'Timeout: 504 after a while' WHEN 1 THEN 'Quota: 429 per' || CASE WHEN event_id % 2 = 0 THEN 'Day' ELSE 'minute' END ELSE 'plain' END END AS error_message FROM events)"""


def latest(s, d):
    return D.latest(log(s, d), ["filename", "cao_number"], "timestamp", "event_id")


def last_written(s, d):
    return D.last_written(log(s, d), ["filename"], "event_id")


def slowest(s, d):
    return log(s, d).orderBy(F.desc("processing_time_seconds"), "event_id").limit(5).select("event_id", "processing_time_seconds")


def most_tokens(s, d):
    return log(s, d).orderBy(F.desc("total_tokens"), "event_id").limit(5).select("event_id", "total_tokens")


def tracked(s, d):
    files = log(s, d).select(F.col("cao_number").alias("key"), F.col("filename").alias("file"))
    n = F.col("file").cast("int")
    return R.tracker(files, {"parsed": files.where(n % 5 != 0), "extracted": files.where((n % 5 != 0) & (n % 7 != 0)), "analysed": files.where((n % 5 != 0) & (n % 7 != 0) & (n % 3 != 0))}, "key", "file")


def validity(s, d):
    """Files by size and suffix: valid or the first reason why not."""
    k = F.col("event_id")
    size = F.when(k % 5 == 1, 0).when(k % 5 == 2, k % 1500).when(k % 5 == 3, k * 20_000).when(k % 5 == 4, 5000)
    suffix = F.when(k % 9 == 0, ".txt").otherwise(".md")
    return table(s, d, "events").select(k, size.cast("long").alias("size"), file_validity(size, suffix).alias("reason"))


def kinds(s, d):
    c = table(s, d, "conversations")
    return c.select("conv_id", F.when(F.col("role") == "user", "Wage").when(F.col("role") == "assistant", "Pension").otherwise("LEAVE").alias("infotype"), F.col("turn").alias("position"), F.concat(F.lit("f"), F.col("turn")).alias("file"), F.when(F.col("turn") % 2 == 0, F.lit("")).when(F.length("text") > 400, F.col("text")).otherwise("").alias("cell"), F.when(F.col("turn") % 4 == 1, "x").otherwise("").alias("other"))


def completeness(s, d):
    """Conversations as documents with a field for each turn; texts of an odd length count as not there."""
    said = F.when(F.length("text") % 2 == 0, F.col("text"))
    c = table(s, d, "conversations").groupBy("conv_id", "turn").agg(F.max(said).alias("v"))
    entry = F.struct(F.concat(F.lit("topic_"), F.lpad(F.col("turn").cast("string"), 3, "0")), F.to_json(F.struct("v")))
    c, fields = c.groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("all")), F.col("all")
    value = lambda v: F.coalesce(F.get_json_object(v, "$.v"), F.lit(""))
    return Q.completeness(c.withColumn("fields", fields), "conv_id", "fields", lambda v: ~missing.has_text(value(v)))


def windows(s, d):
    e = table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("seconds"))
    rows = windowed_progress(e, "ts", "1 hour", "6 hours")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "runs", "failures", F.round("seconds", 4).alias("seconds"))


QUERIES = {
    "event_windows": windows,
    "runlog_latest": latest,
    "runlog_last_written": last_written,
    "runlog_summary": lambda s, d: R.summary(log(s, d), 100),
    "runlog_progress": lambda s, d: R.progress(log(s, d), 200_000, 100),
    "runlog_by_size": lambda s, d: R.by_size(log(s, d)),
    "runlog_errors": lambda s, d: R.errors(log(s, d)),
    "runlog_slowest": slowest,
    "runlog_most_tokens": most_tokens,
    "runlog_retries": lambda s, d: log(s, d).where("not success").groupBy(R.retry_class(F.col("error_message")).alias("retry")).agg(F.count("*").alias("n")),
    "stage_tracker": tracked,
    "file_validity": validity,
    "quality_duplicates": lambda s, d: Q.duplicates(kinds(s, d), ["conv_id", "infotype"], "infotype", "file", "position"),
    "quality_missing_kinds": lambda s, d: Q.missing_kinds(kinds(s, d), "conv_id", "infotype"),
    "quality_empty_rows": lambda s, d: Q.empty_rows(kinds(s, d), "conv_id", "infotype", missing.row_is_empty(["cell", "other"])),
    "document_completeness": completeness,
    "empty_fields": lambda s, d: Q.empty_fields(completeness(s, d), 20),
}

KINDS = "c AS (SELECT conv_id, CASE role WHEN 'user' THEN 'Wage' WHEN 'assistant' THEN 'Pension' ELSE 'LEAVE' END AS infotype, turn AS position, turn % 2 = 0 OR length(text) <= 400 AS no_cell, turn % 4 <> 1 AS no_other FROM conversations)"
COMPLETE = "t AS (SELECT conv_id, turn AS i, coalesce(max(text) FILTER (length(text) % 2 = 0), '') AS v FROM conversations GROUP BY 1, 2), m AS (SELECT conv_id, count(*) AS n_fields, count(*) FILTER (regexp_matches(v, '\\S')) AS n_filled, coalesce(list('topic_' || lpad(i::VARCHAR, 3, '0') ORDER BY i) FILTER (NOT regexp_matches(v, '\\S')), []) AS empty_fields FROM t GROUP BY 1)"
ORACLES = {
    "event_windows": "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H') AS start, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failures, round(sum(value), 4) AS seconds FROM events GROUP BY 1",
    "runlog_latest": f"WITH {LOG} SELECT e.* FROM e WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.filename = e.filename AND y.cao_number = e.cao_number AND (y.timestamp > e.timestamp OR y.timestamp = e.timestamp AND y.event_id < e.event_id))",
    "runlog_last_written": f"WITH {LOG} SELECT e.* FROM e WHERE event_id IN (SELECT max(event_id) FROM e GROUP BY filename)",
    "runlog_summary": f"""WITH {LOG} SELECT count(*) AS total_files_processed, count(*) FILTER (success) AS successful_extractions, count(*) FILTER (NOT success) AS failed_extractions, sum(processing_time_seconds) / 3600 AS total_processing_time_hours,
 sum(total_tokens) AS total_tokens_used, avg(processing_time_seconds) AS avg_processing_time_seconds, avg(total_tokens) AS avg_tokens_per_file, max(file_size_mb) AS largest_file_mb, max(processing_time_seconds) AS slowest_file_seconds,
 max(total_tokens) AS most_tokens_used, count(*) FILTER (success) * 100.0::DOUBLE / count(*) AS success_rate_percent, greatest(0, 100 - count(*)) AS requests_remaining FROM e""",
    "runlog_progress": f"WITH {LOG}, a AS (SELECT count(*) AS n, avg(processing_time_seconds) FILTER (success) AS m FROM e) SELECT n * 100.0::DOUBLE / 200000 AS per_cent, 200000 - n AS remaining, m AS avg_seconds, (200000 - n) * m / 3600 AS hours_left, (200000 - n) / 100::DOUBLE AS days_left FROM a",
    "runlog_by_size": f"WITH {LOG} SELECT CAST(floor(file_size_mb) AS INTEGER) || '-' || CAST(floor(file_size_mb) + 1 AS INTEGER) || 'MB' AS bucket, avg(total_tokens) AS avg_tokens, count(*) AS files FROM e GROUP BY 1",
    "runlog_errors": f"WITH {LOG} SELECT CASE WHEN contains(error_message, ':') THEN split_part(error_message, ':', 1) ELSE 'Unknown' END AS kind, count(*) AS n FROM e WHERE NOT success GROUP BY 1",
    "runlog_slowest": "SELECT event_id, value AS processing_time_seconds FROM events ORDER BY value DESC, event_id LIMIT 5",
    "runlog_most_tokens": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS total_tokens FROM events ORDER BY total_tokens DESC, event_id LIMIT 5",
    "runlog_retries": "SELECT CASE WHEN event_id % 3 = 0 THEN 'timeout' WHEN event_id % 3 = 2 THEN 'other' WHEN event_id % 2 = 0 THEN 'daily quota' ELSE 'quota' END AS retry, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
    "stage_tracker": """WITH f AS (SELECT DISTINCT event_type AS key, user_id AS n, CAST(user_id AS VARCHAR) AS file FROM events)
 SELECT key, count(*) AS found, count(*) FILTER (n % 5 <> 0) AS parsed_ok, count(*) FILTER (n % 5 = 0) AS parsed_failed, coalesce(string_agg(file, ', ' ORDER BY file) FILTER (n % 5 = 0), '') AS parsed_failed_files,
 count(*) FILTER (n % 5 <> 0 AND n % 7 <> 0) AS extracted_ok, count(*) FILTER (n % 5 <> 0 AND n % 7 = 0) AS extracted_failed, coalesce(string_agg(file, ', ' ORDER BY file) FILTER (n % 5 <> 0 AND n % 7 = 0), '') AS extracted_failed_files,
 count(*) FILTER (n % 5 <> 0 AND n % 7 <> 0 AND n % 3 <> 0) AS analysed_ok, count(*) FILTER (n % 5 <> 0 AND n % 7 <> 0 AND n % 3 = 0) AS analysed_failed, coalesce(string_agg(file, ', ' ORDER BY file) FILTER (n % 5 <> 0 AND n % 7 <> 0 AND n % 3 = 0), '') AS analysed_failed_files FROM f GROUP BY key""",
    "file_validity": """WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 1 THEN 0 WHEN 2 THEN event_id % 1500 WHEN 3 THEN event_id * 20000 WHEN 4 THEN 5000 END AS size FROM events)
 SELECT event_id, size, CASE WHEN event_id % 5 = 0 THEN 'missing' WHEN size = 0 THEN 'empty' WHEN size < 1024 THEN 'too small' WHEN size > 52428800 THEN 'too large' WHEN event_id % 9 = 0 THEN 'wrong suffix' ELSE 'valid' END AS reason FROM v""",
    "quality_duplicates": f"WITH {KINDS} SELECT conv_id, infotype, count(*) AS n, 'f' || min(position) AS first_file, list(position ORDER BY position)[:5] AS positions FROM c WHERE infotype <> 'Wage' GROUP BY 1, 2 HAVING count(*) > 1",
    "quality_missing_kinds": f"""WITH {KINDS}, k AS (SELECT conv_id, list(DISTINCT lower(infotype)) AS p FROM c GROUP BY 1)
 SELECT conv_id, list_sort(list_filter(['wage', 'pension', 'leave', 'termination', 'overtime', 'training', 'homeoffice'], lambda x: NOT list_contains(p, x))) AS missing, list_sort(p) AS present FROM k""",
    "quality_empty_rows": f"""WITH {KINDS}, o AS (SELECT conv_id, bool_and(no_cell AND no_other) AS others_all_empty FROM c WHERE infotype <> 'Wage' GROUP BY 1)
 SELECT conv_id, infotype, count(*) AS n, count(*) FILTER (no_cell AND no_other) AS n_empty, any_value(others_all_empty) AS others_all_empty FROM c LEFT JOIN o USING (conv_id) GROUP BY 1, 2""",
    "document_completeness": f"WITH {COMPLETE} SELECT conv_id, n_fields, n_filled, n_filled * 100.0::DOUBLE / n_fields AS per_cent, empty_fields FROM m",
    "empty_fields": f"WITH {COMPLETE} SELECT unnest(empty_fields) AS field, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, field LIMIT 20",
}
