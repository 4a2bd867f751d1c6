"""Spark-native toolkit for listing-like tables: extract, clean, deduplicate,
reject, merge, score, rank and report, in batch and as streams."""

__version__ = "0.1.0"
