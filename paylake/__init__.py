"""Bulk XML payment messages on Spark: read, cut, type, validate, judge, aggregate, export."""
