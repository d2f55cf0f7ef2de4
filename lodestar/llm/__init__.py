"""Operators for building training corpora: deduplication, scoring, packing and scans.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; their query wrappers and SQL are in :mod:`lodestar.llm.queries`.
"""
