"""Readings from parquet, and the JSON sink."""
