"""Versions kept as Parquet: each write appends rows, and a reader sees all whole writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import batches, compaction, reads

SCHEMA = "key string, seq long, rtype int, value double"


def read(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """All versions under ``path``."""
    return spark.read.schema(schema).parquet(path)


def create(spark: SparkSession, path: str, schema: str = SCHEMA) -> None:
    """An empty table of versions."""
    spark.createDataFrame([], schema).write.parquet(path)


def write(spark: SparkSession, path: str, write_batches: DataFrame, schema: str = SCHEMA) -> int:
    """Apply batches (batch_id, ops) after the last sequence number, which is given back. One writer at a time."""
    last = reads.last_sequence(read(spark, path, schema)).first().last_seq
    batches.apply(write_batches, last).write.mode("append").parquet(path)
    return reads.last_sequence(read(spark, path, schema)).first().last_seq


def compact(spark: SparkSession, path: str, to: str, n_files: int, drop: bool = False, schema: str = SCHEMA) -> None:
    """Write the versions anew, sorted, under another path: what is being read is never overwritten."""
    compaction.rewrite(read(spark, path, schema), n_files, drop).withColumn("rtype", F.col("rtype").cast("int")).write.parquet(to)


def files(spark: SparkSession, path: str, level: int = 0, schema: str = SCHEMA) -> DataFrame:
    """level, number, smallest, largest, file_size, n_versions and name of each Parquet file under ``path`` that has rows.

    Only keys and sequence numbers are read, and grouped by file. The files are numbered from 1 in the order of their
    largest sequence numbers, newer ones later.
    """
    seen = read(spark, path, schema).select("key", "seq", F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_size").alias("file_size"))
    each = seen.groupBy("name").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.max("file_size").alias("file_size"), F.count("*").alias("n_versions"), F.max("seq").alias("last_seq"))
    number = F.row_number().over(Window.orderBy("last_seq", "name"))  # a row for each file
    return each.select(F.lit(level).alias("level"), number.cast("long").alias("number"), "smallest", "largest", "file_size", "n_versions", "name")
