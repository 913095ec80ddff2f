"""Replay of file-set edits: rows (edit_id, phase, level, number, ...), phase 0 deleting and 1 adding a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(edits: DataFrame) -> DataFrame:
    """level and number of the files that are there after all edits: an edit's deletions come before its additions."""
    last = edits.groupBy("level", "number").agg(F.max(F.col("edit_id") * 2 + F.col("phase")).alias("o"))
    return last.where("o % 2 = 1").select("level", "number")


def scalars(edits: DataFrame, names: list[str]) -> DataFrame:
    """The last value that isn't null of each of the columns ``names``, by edit_id."""
    return edits.agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("edit_id"))).alias(n) for n in names])


def live_files(edits: DataFrame, cuts: list[int]) -> DataFrame:
    """version and number of the files in each version of a chain, the k-th being what edits up to cuts[k] leave."""
    upto = F.explode(F.array(*[F.struct(F.lit(k).alias("version"), F.lit(c).cast("long").alias("cut")) for k, c in enumerate(cuts)]))
    each = edits.withColumn("c", upto).where("edit_id <= c.cut").groupBy("c.version", "level", "number").agg(F.max(F.col("edit_id") * 2 + F.col("phase")).alias("o"))
    return each.where("o % 2 = 1").select("version", "number")
