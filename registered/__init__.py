"""Queries over the given test tables, in Spark and as plain SQL."""
