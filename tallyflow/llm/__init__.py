"""Operators of a training-data pipeline: deduplication, sharding, packing, scoring, archives, search, filters."""
