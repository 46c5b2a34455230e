"""Operators for training-data pipelines: scoring, extraction, filtering, deduplication, encoding."""
