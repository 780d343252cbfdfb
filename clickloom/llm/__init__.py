"""Operators for preparing training data: packing, deduplication, filters, tokens, search."""
