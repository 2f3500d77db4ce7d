"""Operators for preparing training data: mixing, sketches, near-duplicates, packing, scans and scoring."""
