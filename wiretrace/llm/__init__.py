"""Operators for training-data pipelines: sharding, search, deduplication, scans, tokens, models."""
