"""Queries over validity periods. Orders stand for agreements' periods: key, file, start and end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import periods as P

ARGS = ("k", "s", "e", "fid")


def periods(spark, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    start = F.col("o_orderdate").cast("date")
    days = (F.lit(30) + F.col("o_orderkey") % 335).cast("int")
    return orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("fid"), start.alias("s"), F.date_add(start, days).alias("e"))


PERIODS_SQL = """SELECT o_custkey AS k, o_orderkey AS fid, CAST(o_orderdate AS DATE) AS s,
 CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 335 AS INTEGER) AS e FROM orders"""

#: Gaps without a window: the latest end of all earlier periods, kept only if no earlier period is still open.
GAPS_SQL = f"""WITH p AS ({PERIODS_SQL}),
g AS (SELECT a.k, a.fid, a.s, max(b.e) AS reach FROM p a JOIN p b ON a.k = b.k AND (b.s, b.e, b.fid) < (a.s, a.e, a.fid)
 GROUP BY a.k, a.fid, a.s, a.e),
gaps AS (SELECT k, reach AS gap_start, s AS gap_end, date_diff('day', reach, s) AS gap_days FROM g WHERE s > reach)"""

QUERIES = {
    "coverage_summary": lambda s, d: P.coverage(periods(s, d), *ARGS),
    "coverage_gaps": lambda s, d: P.gaps(periods(s, d), *ARGS).withColumn("gap_months", F.round("gap_months", 6)),
    "renewals": lambda s, d: P.renewals(periods(s, d), *ARGS).withColumn("renewal_months", F.round("renewal_months", 6)),
}

ORACLES = {
    "coverage_summary": GAPS_SQL
    + """ SELECT p.k, min(p.s) AS earliest_start, max(p.e) AS latest_end, count(*) AS num_files, coalesce(any_value(g.n), 0) AS num_gaps,
 CAST(coalesce(any_value(g.d), 0) AS BIGINT) AS total_gap_days, coalesce(any_value(g.n), 0) = 0 AS is_fully_covered,
 round(date_diff('day', min(p.s), max(p.e)) / 30.4375::DOUBLE, 6) AS coverage_months
 FROM p LEFT JOIN (SELECT k, count(*) AS n, sum(gap_days) AS d FROM gaps GROUP BY k) g ON p.k = g.k GROUP BY p.k""",
    "coverage_gaps": GAPS_SQL + " SELECT k, gap_start, gap_end, CAST(gap_days AS INTEGER) AS gap_days, round(gap_days / 30.4375::DOUBLE, 6) AS gap_months FROM gaps",
    "renewals": f"""WITH p AS ({PERIODS_SQL}), r AS (SELECT k, fid, s, (SELECT q.e FROM p q WHERE q.k = p.k AND (q.s, q.fid) < (p.s, p.fid)
 ORDER BY q.s DESC, q.fid DESC LIMIT 1) AS previous_end FROM p)
 SELECT k, fid, previous_end, s AS renewal_start, CAST(date_diff('day', previous_end, s) AS INTEGER) AS renewal_days,
 round(date_diff('day', previous_end, s) / 30.4375::DOUBLE, 6) AS renewal_months FROM r WHERE previous_end IS NOT NULL""",
}
