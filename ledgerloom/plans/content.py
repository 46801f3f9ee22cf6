"""Queries over extracted records. Order lines stand for records, with salary cells by line number and cells left blank on purpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import missing
from ledgerloom.operators import content as C
from ledgerloom.plans.tables import table

SALARIES = [f"salary_{i}" for i in range(1, 8)]
BENEFITS = {"pension": ["pension_age", "flag"], "leave": ["leave_days"], "overtime": ["overtime", "flag"]}


def records(s, d):
    lines, orders = table(s, d, "lineitem"), table(s, d, "orders")
    cell = F.when(F.col("l_discount") == 0, None).when(F.col("l_tax") == 0, "").otherwise(F.col("l_extendedprice").cast("string"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_orderkey").alias("file_id"),
        F.when(F.col("l_tax") < 0.07, F.col("o_custkey")).alias("k"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place"),
        F.col("o_orderdate").cast("date").alias("s"),
        *(F.when(F.col("l_linenumber") == i, cell).alias(f"salary_{i}") for i in range(1, 8)),
        F.when(F.col("o_orderpriority") == "1-URGENT", "yes").alias("more_salaries"),
        F.when(F.col("l_returnflag") == "R", "67").alias("pension_age"),
        F.when(F.col("l_linestatus") == "O", "Empty").when(F.col("l_quantity") > 30, " ").otherwise("").alias("leave_days"),
        F.when(F.col("l_quantity") > 45, "150%").alias("overtime"),
        F.when(F.col("l_quantity") < 3, "\t").when(F.col("l_quantity") > 48, "x").alias("flag"),
    )


RECORDS = """r AS (SELECT o_orderkey AS file_id, CASE WHEN l_tax < 0.07 THEN o_custkey END AS k, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, CAST(o_orderdate AS DATE) AS s, l_linenumber AS n,
 CASE WHEN l_discount = 0 THEN NULL WHEN l_tax = 0 THEN '' ELSE 'v' END AS cell, o_orderpriority = '1-URGENT' AS more, CASE WHEN l_returnflag = 'R' THEN '67' END AS pension_age,
 CASE WHEN l_linestatus = 'O' THEN 'Empty' WHEN l_quantity > 30 THEN ' ' ELSE '' END AS leave_days, CASE WHEN l_quantity > 45 THEN '150%' END AS overtime,
 CASE WHEN l_quantity < 3 THEN chr(9) WHEN l_quantity > 48 THEN 'x' END AS flag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

FILES = RECORDS + """, c AS (SELECT file_id, first(k ORDER BY place) FILTER (k IS NOT NULL) AS k, min(s) AS first_start, max(s) AS last_start, count(DISTINCT n) FILTER (cell = 'v') AS n, bool_or(more) AS more,
 bool_or(pension_age IS NOT NULL OR coalesce(flag = 'x', false)) AS has_pension, bool_or(leave_days = 'Empty') AS has_leave, bool_or(overtime IS NOT NULL OR coalesce(flag = 'x', false)) AS has_overtime FROM r GROUP BY file_id),
f AS (SELECT file_id, k, first_start, last_start, CASE WHEN n = 7 AND more THEN 8 ELSE n END AS salary_tables, has_pension, has_leave, has_overtime FROM c)"""


def files(s, d):
    return C.per_file(records(s, d), "file_id", "k", "place", "s", SALARIES, "more_salaries", BENEFITS)


def presence_by_key(s, d):
    return C.presence(files(s, d), "k", F.col("salary_tables") > 0)


def presence_by_year(s, d):
    return C.presence(files(s, d).withColumn("year", F.year("first_start")), "year", F.col("has_pension"))


def missing_by_key(s, d):
    return C.missing_share(files(s, d).withColumn("has_salary", F.col("salary_tables") > 0), "k", ["has_salary", "has_pension", "has_leave", "has_overtime"])


def benefit_totals(s, d):
    flags = ["has_pension", "has_leave", "has_overtime"]
    rows = files(s, d)
    means = rows.agg(*((F.avg(F.col(c).cast("int")) * 100).alias(c) for c in flags)).unpivot([], flags, "benefit", "per_cent")
    sums = rows.agg(*(F.count_if(c).alias(c) for c in flags)).unpivot([], flags, "benefit", "files")
    return means.join(sums, "benefit")


def top_benefits(s, d):
    return C.most_present(benefit_totals(s, d), "benefit", "per_cent")


def last_year(s, d):
    """The last year that has files with salary tables, with its figures."""
    rows = C.presence(files(s, d).withColumn("year", F.year("last_start")), "year", F.col("salary_tables") > 0)
    return C.last_known(rows.withColumn("per_cent", F.when(F.col("with_flag") > 0, F.col("per_cent"))), "year", "per_cent")


def audit(s, d):
    return C.audit(records(s, d), BENEFITS)


def kept_rows(s, d):
    """How many records each of the row filters keeps, by year."""
    cells = [*SALARIES, "pension_age", "leave_days", "overtime", "flag"]
    counted = lambda c: F.count_if(c)
    return records(s, d).groupBy(F.year("s").alias("year")).agg(
        F.count("*").alias("n"),
        counted(missing.any_content(cells)).alias("with_content"),
        counted(missing.any_content(cells, missing.CELL_PLACEHOLDERS)).alias("with_cells"),
        counted(missing.row_is_empty([*SALARIES, "pension_age"])).alias("empty_with_pension"),
        counted(missing.row_is_empty(SALARIES)).alias("empty"),
        counted(missing.is_truthy(F.col("leave_days"))).alias("truthy"),
        counted(missing.has_text(F.col("leave_days"))).alias("with_text"),
    )


def mean_of_means(s, d):
    """Benefits by part of the market: the mean of customers' means."""
    customers = table(s, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    per_key = files(s, d).where("k is not null").groupBy("k").agg(F.avg("salary_tables").alias("mean_tables"))
    return per_key.join(customers, "k").groupBy("c_mktsegment").agg(F.avg("mean_tables").alias("mean_tables"), F.count("*").alias("n"))


def coverage_and_content(s, d):
    from ledgerloom.operators import periods as P
    from ledgerloom.plans.periods import ARGS, periods

    tables = files(s, d).where("k is not null").groupBy("k").agg(F.avg("salary_tables").alias("mean_tables"))
    return P.coverage(periods(s, d), *ARGS).select("k", "num_gaps", "coverage_months").join(tables, "k", "inner")


def _coverage_sql():
    from ledgerloom.plans.periods import ORACLES

    return ORACLES["coverage_summary"]


QUERIES = {"content_files": files, "salary_presence": presence_by_key, "benefit_by_year": presence_by_year, "benefit_missing": missing_by_key, "benefit_totals": benefit_totals, "top_benefits": top_benefits, "last_salary_year": last_year, "benefit_audit": audit, "record_filters": kept_rows, "benefit_segments": mean_of_means, "coverage_and_content": coverage_and_content}

FLAG_SQL = " UNION ALL ".join(f"SELECT k, '{c}' AS name, avg(CASE WHEN {e} THEN 0 ELSE 1 END) * 100 AS missing FROM f WHERE k IS NOT NULL GROUP BY k" for c, e in (("has_salary", "salary_tables > 0"), ("has_pension", "has_pension"), ("has_leave", "has_leave"), ("has_overtime", "has_overtime")))
TOTAL_SQL = " UNION ALL ".join(f"SELECT '{c}' AS benefit, avg({c}::INT) * 100 AS per_cent, count(*) FILTER ({c}) AS files FROM f" for c in ("has_pension", "has_leave", "has_overtime"))
ORACLES = {
    "content_files": f"WITH {FILES} SELECT * FROM f",
    "salary_presence": f"WITH {FILES} SELECT k, avg((salary_tables > 0)::INT) * 100 AS per_cent, count(*) AS files, sum((salary_tables > 0)::INT) AS with_flag FROM f WHERE k IS NOT NULL GROUP BY k",
    "benefit_by_year": f"WITH {FILES} SELECT year(first_start) AS year, avg(has_pension::INT) * 100 AS per_cent, count(*) AS files, sum(has_pension::INT) AS with_flag FROM f GROUP BY 1",
    "benefit_missing": f"WITH {FILES} {FLAG_SQL}",
    "benefit_totals": f"WITH {FILES} {TOTAL_SQL}",
    "top_benefits": f"WITH {FILES} SELECT * FROM ({TOTAL_SQL}) ORDER BY per_cent DESC, benefit LIMIT 3",
    "last_salary_year": f"WITH {FILES} SELECT year(last_start) AS year, avg((salary_tables > 0)::INT) * 100 AS per_cent, count(*) AS files, sum((salary_tables > 0)::INT) AS with_flag FROM f GROUP BY 1 HAVING sum((salary_tables > 0)::INT) > 0 ORDER BY year DESC LIMIT 1",
    "benefit_audit": f"""WITH {RECORDS}, n AS (SELECT count(pension_age) AS a, count(*) FILTER (flag = 'x') AS b, count(*) FILTER (leave_days = 'Empty') AS c, count(overtime) AS d FROM r)
 SELECT 'pension' AS benefit, 'pension_age' AS "column", a AS non_empty_rows, '' AS matched_multiple FROM n UNION ALL SELECT 'pension', 'flag', b, 'pension,overtime' FROM n
 UNION ALL SELECT 'leave', 'leave_days', c, '' FROM n UNION ALL SELECT 'overtime', 'overtime', d, '' FROM n UNION ALL SELECT 'overtime', 'flag', b, 'pension,overtime' FROM n""",
    "record_filters": f"""WITH {RECORDS}, x AS (SELECT *, coalesce(cell, '') = 'v' OR pension_age IS NOT NULL OR overtime IS NOT NULL OR flag IS NOT NULL AS filled FROM r)
 SELECT year(s) AS year, count(*) AS n, count(*) FILTER (filled) AS with_content, count(*) FILTER (filled OR leave_days = ' ') AS with_cells, count(*) FILTER (cell IS NULL AND pension_age IS NULL) AS empty_with_pension,
 count(*) FILTER (cell IS NULL) AS empty, count(*) FILTER (leave_days <> '') AS truthy, count(*) FILTER (leave_days = 'Empty') AS with_text FROM x GROUP BY 1""",
    "benefit_segments": f"WITH {FILES}, m AS (SELECT k, avg(salary_tables) AS a FROM f WHERE k IS NOT NULL GROUP BY k) SELECT c_mktsegment, avg(a) AS mean_tables, count(*) AS n FROM m JOIN customer ON k = c_custkey GROUP BY 1",
    "coverage_and_content": f"WITH {FILES}, cov AS ({_coverage_sql()}), m AS (SELECT k, avg(salary_tables) AS mean_tables FROM f WHERE k IS NOT NULL GROUP BY k) SELECT m.k, num_gaps, coverage_months, mean_tables FROM m JOIN cov ON m.k = cov.k",
}
