"""Operators of a training-data pipeline: encoding, search, deduplication, archives, scans, scores and mixing."""
