"""More queries over validity periods: counts by year, histograms, correlation, subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import periods as P
from ledgerloom.plans.periods import ARGS, GAPS_SQL, ORACLES as OWN, PERIODS_SQL, periods


def lengths(s, d):
    return periods(s, d).withColumn("days", F.datediff("e", "s"))


def by_key(s, d):
    rows = lengths(s, d)
    return rows.groupBy("k").agg(F.min("s").alias("first"), F.max("e").alias("last"), F.count("*").alias("n"), F.avg("days").alias("mean_days"), F.median("days").alias("median_days"))


def renewal_stats(s, d):
    rows = P.renewals(periods(s, d), *ARGS)
    positive = F.when(F.col("renewal_days") > 0, F.col("renewal_days"))
    return rows.groupBy("k").agg(F.count("*").alias("n"), F.avg("renewal_days").alias("mean_days"), F.median("renewal_days").alias("median_days"), F.count(positive).alias("n_positive"), F.avg(positive).alias("mean_positive"), F.median(positive).alias("median_positive"))


def subsets(s, d):
    """The same figures of all renewals and of those with a gap."""
    rows = P.renewals(periods(s, d), *ARGS)
    figures = [F.count("*").alias("n"), F.avg("renewal_months").alias("mean_months"), F.median("renewal_months").alias("median_months")]
    every = rows.agg(*figures).select(F.lit("all").alias("subset"), "*")
    return every.unionByName(rows.where("renewal_days > 0").agg(*figures).select(F.lit("positive").alias("subset"), "*"))


def by_year(s, d):
    return P.yearly(periods(s, d), "s", "e")


def every_year(s, d):
    counts = periods(s, d).groupBy(F.year("e").alias("year")).agg(F.count("*").alias("n"))
    return P.densified(counts, "year", "n")


def gaps_every_length(s, d):
    """How many gaps have each length, lengths without any too."""
    counts = P.gaps(periods(s, d), *ARGS).groupBy(F.col("gap_days").cast("int").alias("days")).agg(F.count("*").alias("n"))
    return P.densified(counts, "days", "n")


def by_month(s, d):
    counts = periods(s, d).groupBy(F.month("s").alias("month")).agg(F.count("*").alias("n"))
    return P.densified(counts, "month", "n")


def gap_histogram(s, d):
    return P.histogram(P.gaps(periods(s, d), *ARGS), "gap_days", 30)


def coverage_correlation(s, d):
    return P.correlations(P.coverage(periods(s, d), *ARGS), "num_files", "total_gap_days")


def report(s, d):
    """The figures of the report: keys, periods, fully covered keys, mean coverage."""
    rows = P.coverage(periods(s, d), *ARGS)
    return rows.agg(F.countDistinct("k").alias("keys"), F.sum("num_files").alias("periods"), F.count_if("is_fully_covered").alias("fully_covered"), F.round(F.avg("coverage_months"), 6).alias("mean_months"), F.round(F.avg("num_gaps"), 6).alias("mean_gaps"))


def keyed_gaps(s, d):
    """Keys with the figures of their renewals, and of those with a gap where there are any."""
    every = P.renewals(periods(s, d), *ARGS)
    left = every.groupBy("k").agg(F.count("*").alias("n"))
    right = every.where("renewal_days > 0").groupBy("k").agg(F.sum("renewal_days").alias("gap_days"))
    return left.join(right, "k", "left").orderBy("k")


COVERAGE_SQL = f"coverage AS ({OWN['coverage_summary'].replace('WITH p', 'WITH p', 1)})"
RENEWALS_SQL = f"renewals AS ({OWN['renewals']})"

QUERIES = {"periods_by_key": by_key, "renewal_stats": renewal_stats, "renewal_subsets": subsets, "periods_by_year": by_year, "periods_every_year": every_year, "gaps_every_length": gaps_every_length, "periods_by_month": by_month, "gap_histogram": gap_histogram, "coverage_correlation": coverage_correlation, "coverage_report": report, "renewals_with_gaps": keyed_gaps}

ORACLES = {
    "periods_by_key": f"WITH p AS ({PERIODS_SQL}) SELECT k, min(s) AS first, max(e) AS last, count(*) AS n, avg(e - s) AS mean_days, median(e - s) AS median_days FROM p GROUP BY k",
    "renewal_stats": f"""WITH {RENEWALS_SQL} SELECT k, count(*) AS n, avg(renewal_days) AS mean_days, median(renewal_days) AS median_days, count(*) FILTER (renewal_days > 0) AS n_positive,
 avg(renewal_days) FILTER (renewal_days > 0) AS mean_positive, median(renewal_days) FILTER (renewal_days > 0) AS median_positive FROM renewals GROUP BY k""",
    "renewal_subsets": f"""WITH {RENEWALS_SQL}, m AS (SELECT renewal_days, renewal_days / 30.4375::DOUBLE AS months FROM renewals)
 SELECT 'all' AS subset, count(*) AS n, avg(months) AS mean_months, median(months) AS median_months FROM m UNION ALL SELECT 'positive', count(*), avg(months), median(months) FROM m WHERE renewal_days > 0""",
    "periods_by_year": f"""WITH p AS ({PERIODS_SQL}), y AS (SELECT year(s) AS year, 1 AS a, 0 AS b FROM p UNION ALL SELECT year(e), 0, 1 FROM p) SELECT year, sum(a) AS starts, sum(b) AS ends FROM y GROUP BY year""",
    "periods_every_year": f"""WITH p AS ({PERIODS_SQL}), c AS (SELECT year(e) AS year, count(*) AS n FROM p GROUP BY 1)
 SELECT y.year, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM c) y LEFT JOIN c ON y.year = c.year""",
    "periods_by_month": f"WITH p AS ({PERIODS_SQL}) SELECT month(s) AS month, count(*) AS n FROM p GROUP BY 1",
    "gaps_every_length": GAPS_SQL + ", c AS (SELECT CAST(gap_days AS INTEGER) AS days, count(*) AS n FROM gaps GROUP BY 1) SELECT y.days, coalesce(c.n, 0) AS n FROM (SELECT unnest(range(min(days), max(days) + 1)) AS days FROM c) y LEFT JOIN c ON y.days = c.days",
    "gap_histogram": GAPS_SQL + """, b AS (SELECT min(gap_days) AS a, max(gap_days) AS b, count(*) AS total FROM gaps), w AS (SELECT a, (b - a) / 30::DOUBLE AS w, total FROM b)
 SELECT CAST(least(floor((gap_days - a) / w), 29) AS INTEGER) AS bin, any_value(a + least(floor((gap_days - a) / w), 29) * w) AS low, any_value(a + least(floor((gap_days - a) / w), 29) * w + w) AS high,
 count(*) AS n, count(*) * 100.0 / any_value(total) AS per_cent FROM gaps, w GROUP BY 1""",
    "coverage_correlation": f"""WITH {COVERAGE_SQL}, r AS (SELECT num_files AS x, total_gap_days AS y, rank() OVER (ORDER BY num_files) + (count(*) OVER (PARTITION BY num_files) - 1) / 2 AS rx,
 rank() OVER (ORDER BY total_gap_days) + (count(*) OVER (PARTITION BY total_gap_days) - 1) / 2 AS ry FROM coverage) SELECT corr(x, y) AS pearson, corr(rx, ry) AS spearman, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM r""",
    "coverage_report": f"""WITH {COVERAGE_SQL} SELECT count(DISTINCT k) AS keys, sum(num_files) AS periods, count(*) FILTER (is_fully_covered) AS fully_covered, round(avg(coverage_months), 6) AS mean_months, round(avg(num_gaps), 6) AS mean_gaps FROM coverage""",
    "renewals_with_gaps": f"""WITH {RENEWALS_SQL} SELECT k, count(*) AS n, sum(renewal_days) FILTER (renewal_days > 0) AS gap_days FROM renewals GROUP BY k""",
}
