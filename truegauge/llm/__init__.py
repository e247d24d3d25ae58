"""Operators for training-data pipelines: archives, near copies, filters, privacy, scoring, tokens.

Each operator takes and returns DataFrames and names rows by a key column of the
caller; the queries over the driver tables are in ``queries``.
"""
