"""Operators for large text corpora: filtering, deduplication, tokenising, packing and scoring.

Nothing outside this subpackage imports it.  Every operator takes DataFrames plus
column names, selects the columns it needs first (so extra columns, and columns whose
names would clash with its own, are ignored) and keeps state on the executors.
"""
