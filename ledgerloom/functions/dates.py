"""Dates in texts, and periods in days and months."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Formats tried in order, with the day and with the month first.
DAY_FIRST = ("d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d", "d-M-yy")
MONTH_FIRST = ("M-d-yyyy", "M/d/yyyy", "M.d.yyyy", "yyyy-M-d", "yyyy/M/d", "M-d-yy")
#: Two-digit years are 1969 to 2068. Fixed value.
PIVOT = 2069
#: Forms of a date after a label, in the order in which they are tried. Fixed values.
LABELLED = (r"\d{1,2}-\d{1,2}-\d{4}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{1,2}\.\d{1,2}\.\d{4}", r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}-\d{1,2}-\d{2}")
#: Labels of the date of the formal notice. Fixed values.
FORMAL_NOTICE, SHORT_NOTICE = "Datum formele Kennisgeving van Ontvangst", "kvo datum"
#: What is read as a real date, with the day and with the year first. Fixed values.
DAY_DATE, YEAR_DATE = r"(\d{1,2})[/-](\d{1,2})[/-](\d{4})", r"(\d{4})-(\d{1,2})-(\d{1,2})"
#: Forms of a date in running text; one place can have several. Fixed values.
IN_TEXT = (r"\d{1,2}-\d{1,2}-\d{4}", r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{4}/\d{1,2}/\d{1,2}")


def try_formats(text: Column, formats: Sequence[str]) -> Column:
    def parsed(form: str) -> Column:
        day = F.try_to_date(F.trim(text), form)
        return day if "yyyy" in form else F.when(F.year(day) >= PIVOT, F.add_months(day, -1200)).otherwise(day)

    return F.coalesce(*(parsed(f) for f in formats))


def parse_column(rows: DataFrame, column: str, into: str) -> DataFrame:
    """Adds into: the dates of a text column, day first. Only where over half of all rows fail are they tried month first."""
    parsed = rows.withColumn(into, try_formats(F.col(column), DAY_FIRST))
    failed = parsed.agg((F.avg(F.col(into).isNull().cast("int")) > 0.5).alias("_mostly_failed"))
    joined = parsed.join(F.broadcast(failed))  # one row
    other = F.when(F.col("_mostly_failed"), try_formats(F.col(column), MONTH_FIRST))
    return joined.withColumn(into, F.coalesce(into, other)).drop("_mostly_failed")


def labelled(text: Column, label: str, forms: Sequence[str] = LABELLED) -> Column:
    """The date after a label, in the first form that is found anywhere; null if there is none. The text is searched once for all forms."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i){label}\s*:?\s*({'|'.join(forms)})"), 1)

    def first(form: str) -> Column:
        return F.get(F.filter(found, lambda m: m.rlike(f"^(?:{form})$")), F.lit(0))

    return F.coalesce(*map(first, forms))


def notified(text: Column) -> Column:
    """The date of the formal notice: after its full label in any form, else after the short one in the first two forms."""
    return F.coalesce(labelled(text, FORMAL_NOTICE), labelled(text, SHORT_NOTICE, LABELLED[:2]))


def iso_or_same(text: Column) -> Column:
    """The first real date in a text as yyyy-MM-dd, else the text. Month names are not read: their form never makes a date."""
    plain = F.trim(text)
    day_first = F.regexp_extract(plain, DAY_DATE, 0)
    year_first = F.regexp_extract(plain, YEAR_DATE, 0)
    found = F.coalesce(F.try_to_date(F.replace(day_first, F.lit("/"), F.lit("-")), "d-M-yyyy"), F.try_to_date(year_first, "yyyy-M-d"))
    return F.when(F.length(text) == 0, None).otherwise(F.coalesce(F.date_format(found, "yyyy-MM-dd"), plain))


def all_in(text: Column, forms: Sequence[str] = IN_TEXT) -> Column:
    return F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(form), 0) for form in forms)))
