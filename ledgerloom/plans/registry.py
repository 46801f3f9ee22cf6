"""Collects the queries of all sections. A section is a module with QUERIES and ORACLES."""

from __future__ import annotations

from ledgerloom.plans import content, documents, formats, monitoring, nested, period_stats, periods, relations, runs, scalars

SECTIONS = (periods, period_stats, scalars, content, relations, monitoring, documents, nested, runs, formats)


def queries() -> dict:
    return {name: f for section in SECTIONS for name, f in section.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for section in SECTIONS for name, sql in section.ORACLES.items()}
