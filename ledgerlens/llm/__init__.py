"""Operators for preparing training text: scans, filters, duplicates, scores, mixing, extraction."""
