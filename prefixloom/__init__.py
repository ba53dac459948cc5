"""Prefix-reuse analytics on Spark: prefix matching, reuse accounting, eviction, chunk dedup, traces, vectors, streams."""
