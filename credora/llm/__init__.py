"""Operators of a training-data pipeline: deduplication, filtering, formatting, packing, mixing."""
