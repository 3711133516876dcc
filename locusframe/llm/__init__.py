"""Operators for preparing training data: filters, deduplication, mixing, sharding and formatting."""
