"""Versions as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.sources.versions import SCHEMA


def tail(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_batch: int | None = None, since: int | None = None) -> DataFrame:
    """A stream of the versions that are appended under ``path``, those after the sequence number ``since`` if it is given."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(path)
    return stream if since is None else stream.where(F.col("seq") > since)


def append(versions: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends a stream of versions to ``path``, each once."""
    return versions.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
