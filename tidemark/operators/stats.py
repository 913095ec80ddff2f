"""Sizes, offsets and properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.order import PARTS, weight_below, weight_between


def approximate_sizes(ranges: DataFrame, files: DataFrame, parts: int = PARTS) -> DataFrame:
    """id and n_bytes: the sizes of all files that overlap each half-open range (id, low, high)."""
    spans = files.select(F.col("smallest").alias("first"), F.col("largest").alias("last"), F.col("file_size").alias("w"))
    return weight_between(ranges.withColumn("closed", F.lit(False)), spans, parts).withColumnRenamed("w", "n_bytes")


def approximate_offsets(points: DataFrame, files: DataFrame, parts: int = PARTS) -> DataFrame:
    """id and offset: the sizes of all files wholly before each key (id, key)."""
    ends = files.select(F.col("largest").alias("key"), F.col("file_size").alias("w"))
    return weight_below(points.withColumn("at_key", F.lit(False)), ends, parts).withColumnRenamed("below", "offset")


def describe_tables(files: DataFrame) -> DataFrame:
    """level and description of each file."""
    return files.select("level", F.format_string("%d:%d[%s .. %s]", "number", "file_size", "smallest", "largest").alias("description"))
