"""Posting analytics on Spark: ingestion, parsing, contracts, merging, quality and search."""
