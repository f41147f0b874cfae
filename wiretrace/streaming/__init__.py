"""Structured Streaming forms of ingestion and of the running aggregates."""
