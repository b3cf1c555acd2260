"""Operators of a training-data pipeline: sharding, scoring, filtering, near-duplicates, archives, formatting, tokens."""
