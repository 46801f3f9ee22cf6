"""Analytics of extracted records: which benefits a file has values for, and what is missing.

A record is a row of text cells with a file and a key (its agreement). All per-file facts come from one aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.missing import has_text

#: Salary tables that a record has columns for; a file that has them all and says there are more counts one more.
SALARY_TABLES = 7


def salary_tables(columns: Sequence[str], more: str) -> Column:
    """How many of the columns have a value in some record of the file."""
    count = sum((F.bool_or(has_text(F.col(c))).cast("int") for c in columns), F.lit(0))
    says_more = F.bool_or(F.coalesce(F.lower(F.trim(F.col(more))) == "yes", F.lit(False)))
    return F.when((count == len(columns)) & says_more, len(columns) + 1).otherwise(count).cast("int")


def per_file(records: DataFrame, file: str, key: str, position: str, start: str, salaries: Sequence[str], more: str, benefits: Mapping[str, Sequence[str]]) -> DataFrame:
    """file, key (of its first record), first and last start, number of salary tables, and a flag for each benefit."""
    known = records.where(F.col(file).isNotNull())
    flags = [F.bool_or(F.exists(F.array(*(F.col(c).cast("string") for c in columns)), has_text)).alias(f"has_{name}") for name, columns in benefits.items()]
    first_key = F.min_by(key, F.when(F.col(key).isNotNull(), F.col(position))).alias(key)
    return known.groupBy(file).agg(first_key, F.min(start).alias("first_start"), F.max(start).alias("last_start"), salary_tables(salaries, more).alias("salary_tables"), *flags)


def presence(files: DataFrame, by: str, flag: Column) -> DataFrame:
    """by, per_cent, files and number with the flag."""
    value = flag.cast("int")
    rows = files.where(F.col(by).isNotNull()).groupBy(by)
    return rows.agg((F.avg(value) * 100).alias("per_cent"), F.count("*").alias("files"), F.sum(value).cast("long").alias("with_flag"))


def most_present(shares: DataFrame, name: str, by: str, n: int = 3) -> DataFrame:
    """The n names with the largest shares, in order (a report's feature)."""
    return shares.orderBy(F.desc_nulls_last(by), F.asc(name)).limit(n)


def last_known(rows: DataFrame, at: str, value: str) -> DataFrame:
    """The row with the greatest at among those that have a value; none for no such row. One pass with partial aggregates."""
    known = rows.where(F.col(value).isNotNull() & F.col(at).isNotNull())
    last = known.agg(F.max(F.struct(at, *(c for c in rows.columns if c != at))).alias("_last")).where("_last is not null")
    return last.select(*(F.col(f"_last.{c}").alias(c) for c in rows.columns))


def missing_share(files: DataFrame, by: str, flags: Sequence[str]) -> DataFrame:
    """by, name and per cent of files without each flag, long form."""
    shares = [(F.avg(F.when(F.col(c), 0).otherwise(1)) * 100).alias(c) for c in flags]
    return files.where(F.col(by).isNotNull()).groupBy(by).agg(*shares).unpivot([by], list(flags), "name", "missing")


def audit(records: DataFrame, benefits: Mapping[str, Sequence[str]]) -> DataFrame:
    """benefit, column, rows with a value, and other benefits that the column belongs to as well."""
    columns = sorted({c for own in benefits.values() for c in own})
    counted = records.agg(*(F.count_if(has_text(F.col(c))).alias(c) for c in columns)).unpivot([], columns, "column", "non_empty_rows")
    named = {c: [b for b, own in benefits.items() if c in own] for c in columns}
    benefit = F.create_map(*(x for c in columns for x in (F.lit(c), F.array(*map(F.lit, named[c])))))[F.col("column")]
    rows = counted.withColumn("all", benefit)
    return rows.select(F.explode("all").alias("benefit"), "column", "non_empty_rows", F.when(F.size("all") > 1, F.array_join("all", ",")).otherwise("").alias("matched_multiple"))


def resolve(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first column whose normal form contains a candidate, candidates in order. Underscores of columns become spaces first."""
    plain = {c: c.strip().lower().translate(str.maketrans("\n\r_", "   ")).strip() for c in columns}
    return next((c for k in candidates for c in columns if k in plain[c]), None)


def column_groups(columns: Sequence[str], patterns: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """The columns whose lower-case name contains a pattern of each group."""
    return {name: [c for c in columns if any(p in c.lower() for p in own)] for name, own in patterns.items()}


def schema_coverage(main: Sequence[str], *parts: Sequence[str]) -> dict[str, list[str]]:
    """Of the names of a schema and of its parts together: common, missing in the parts, and extra in them."""
    other = {c for part in parts for c in part}
    return {"common": [c for c in main if c in other], "missing": [c for c in main if c not in other], "extra": sorted(other - set(main))}
