"""Readers and writers for the formats the pipeline meets."""
