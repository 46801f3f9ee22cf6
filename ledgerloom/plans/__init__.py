"""Registered queries, each beside the SQL that states the same result."""
