"""Operators for preparing training text: filters, scans, deduplication and packing."""
