"""Operators for preparing training data: sharding, filters, near-duplicates, packing and scoring."""
