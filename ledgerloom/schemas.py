"""Schemas of what is read and written."""

from __future__ import annotations

from pyspark.sql.types import StringType, StructField, StructType

#: Pages of a document, topics of a document (each a list of lists), periods of agreements and found links.
PAGES = "array<struct<page:int,ocr_used:boolean,text:string>>"
TOPICS = ", ".join(f"{t}_information array<array<string>>" for t in ("general", "wage", "pension", "leave", "termination", "overtime", "training", "homeoffice"))
AGREEMENT_INFO = "cao_number int, id string, ingangsdatum string, expiratiedatum string, datum_kennisgeving string, pdf_name string, page_name string, main_link_url string"
LINK_LOG = "cao_number int, main_link_url string, pdf_found boolean, pdf_name string, pdfs_found_count int, id string"


def records(header: list[str]) -> StructType:
    """The extracted table: every column is text."""
    return StructType([StructField(c, StringType()) for c in header])
