"""Operators for training-data pipelines: search, filters, deduplication, packing and output."""
