"""Operators for training-data pipelines: sharding, search, packing, dedup, quality, PII, LM scoring, WARC.

Nothing outside this subpackage imports it.
"""
