"""Operators of a training-data pipeline: deduplication, quality, archives, mixing, tokens."""
