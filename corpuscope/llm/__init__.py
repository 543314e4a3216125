"""Operators of a training-data pipeline: search, deduplication, packing, token output, scoring and scanning of texts."""
