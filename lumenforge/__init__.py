"""Spark-first statistical, sequence and feature analytics over delimited and parquet data."""
