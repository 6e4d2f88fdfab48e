"""Operators for training data: deduplication, filters, extraction and tokens. Nothing else in the library imports this."""
