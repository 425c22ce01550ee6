"""Operators for training-data pipelines: deduplication, filtering, scoring, packing, sharding."""
