"""Operators for training data: deduplication, packing, joins of similar texts, filters and mixing."""
