"""Operators for training-data pipelines: scoring, tokenising, de-duplication, search, packing and counts."""
