"""Operators for training-data pipelines: extraction, search, deduplication,
decontamination, mixing, sharding and scoring.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
