"""Joins, windows, aggregations and set operations over document and period tables."""
