"""Tidemark: ordered, multi-version key-value data as Spark DataFrames."""
