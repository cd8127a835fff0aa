"""Operators for preparing training text: archives, deduplication, filters, scores, mixtures, sketches."""
