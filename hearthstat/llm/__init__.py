"""Operators for training-data pipelines: quality rules, extraction, tokenising, mixing, scoring, deduplication, search."""
