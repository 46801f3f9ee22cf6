"""From topic documents to rows of the extracted table, and from pages to documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.missing import is_truthy
from ledgerloom.operators.joins import propagated

#: Columns that each kind of row keeps. Fixed values.
KIND_COLUMNS = {
    "Pension": ("pension_premium_basic", "pension_premium_plus", "retire_age_basic", "retire_age_plus", "pension_age_group"),
    "Leave": ("maternity_leave", "maternity_pay", "maternity_note", "vacation_time", "vacation_unit", "vacation_note"),
    "Termination": ("term_period_employer", "term_employer_note", "term_period_worker", "term_worker_note", "probation_period", "probation_note"),
    "Overtime": ("overtime_compensation", "max_hrs", "min_hrs", "shift_compensation", "overtime_allowance_min", "overtime_allowance_max"),
    "Training": ("training",),
    "Homeoffice": ("Homeoffice",),
}
#: Columns of a contract's dates. Fixed values.
CONTRACT = ("start_date_contract", "expiry_date_contract")
#: Topics of a document in order, and its parts. Fixed values.
TOPICS = ("general", "wage", "pension", "leave", "termination", "overtime", "training", "homeoffice")


def joined_lists(topic: Column, depth: int = 2) -> Column:
    """A topic's list of lists as a list of texts. depth: how many lists the column's type has one in another; inner ones are joined first."""

    def flat(value: Column, left: int) -> Column:
        return F.array_join(value if left == 1 else F.transform(value, lambda v: flat(v, left - 1)), " | ")

    return topic if depth == 1 else F.transform(topic, lambda row: flat(row, depth - 1))


def topic_text(title: str, lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"== {title} ==\n"), F.array_join(lines, "\n")))


def fan_out(wages: DataFrame, others: DataFrame, key: str, position: str, columns: Sequence[str], kinds: Mapping[str, Sequence[str]] = KIND_COLUMNS) -> DataFrame:
    """One row of kind Wage for each wage item, and one of every other kind for each other item; all have all columns, '' where nothing is known.

    Wage rows get the last contract dates of their document's other items, other rows those of their own item.
    """
    def cell(df: DataFrame, c: str) -> Column:
        return F.when(is_truthy(F.col(c)), F.col(c).cast("string")).otherwise("").alias(c) if c in df.columns else F.lit("").alias(c)

    dated = propagated(wages.drop(*CONTRACT), others, key, position, CONTRACT)
    wage_rows = dated.select(key, F.col(position).alias("item"), F.lit("Wage").alias("infotype"), *(cell(dated, c) for c in columns))
    each = F.explode(F.array(*map(F.lit, kinds)))
    spread = others.withColumn("infotype", each)
    kept = {c: [k for k, own in kinds.items() if c in own] for c in columns}
    own_cell = lambda c: cell(spread, c) if c in CONTRACT else F.when(F.col("infotype").isin(*kept[c]) if kept[c] else F.lit(False), cell(spread, c)).otherwise("").alias(c)
    other_rows = spread.select(key, F.col(position).alias("item"), "infotype", *(own_cell(c) for c in columns))
    return wage_rows.unionByName(other_rows)


def to_schema(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with these columns only, in order, '' for missing cells and columns."""
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns))


def filled_rows(rows: DataFrame, meta: Sequence[str]) -> DataFrame:
    """Rows with some cell outside meta that is neither null, '' nor Empty."""
    cells = [F.col(c).cast("string") for c in rows.columns if c not in meta]
    return rows.where(F.exists(F.array(*cells), lambda c: F.coalesce(~c.isin("", "Empty"), F.lit(False))))


def schema_from_header(line: str) -> list[str]:
    """Column names of the header of a markdown table."""
    return [c.strip() for c in line.split("|") if c.strip()]


def markdown_document(pages: DataFrame, key: str, page: str, text: str, recognised: str, title: str) -> DataFrame:
    """key and one markdown text of its pages in order; blank pages are left out and recognised ones say so.

    A document is one text, so its pages meet in one task; documents are spread by key.
    """
    said = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    note = F.when(F.col(recognised), "*[Text extracted using OCR]*\n").otherwise("")
    block = F.concat(F.lit("## Page "), F.col(page).cast("string"), F.lit("\n"), note, said, F.lit("\n\n"))
    rows = pages.select(key, page, F.when(F.length(said) > 0, block).alias("block"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct(page, "block"))))
    body = F.array_join(F.transform(ordered, lambda x: x["block"]), "")
    head = F.concat(F.lit(f"# {title}\n*Converted from: "), F.col(key).cast("string"), F.lit("*\n---\n"))
    return rows.groupBy(key).agg(body.alias("body")).select(key, F.concat(head, "body").alias("markdown"))


def markdown_table(rows: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """The lines of a markdown table as rows of (n, line): a header, a rule and a line for each row, in order."""
    cells = [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns]
    lines = rows.select(F.col(order).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    spark = rows.sparkSession
    head = spark.createDataFrame([(-2, "| " + " | ".join(columns) + " |"), (-1, "|" + " --- |" * len(columns))], "n long, line string")
    return head.unionByName(lines.withColumn("n", F.col("n").cast("long")))
