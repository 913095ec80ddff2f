"""Merges of sorted runs: all versions of all runs in one order, none dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(runs: list[DataFrame], reverse: bool = False) -> DataFrame:
    """The rows of all runs with run_id, by key, then from the newest version, then by run; backwards on demand."""
    if not runs:
        raise ValueError("a merge needs at least one run")
    tagged = [r.withColumn("run_id", F.lit(k)) for k, r in enumerate(runs)]
    order = [F.asc("key"), F.desc("seq"), F.desc("rtype"), F.asc("run_id")]
    if reverse:
        order = [F.desc("key"), F.asc("seq"), F.asc("rtype"), F.desc("run_id")]
    return reduce(DataFrame.unionByName, tagged).orderBy(*order)


def two_level_scan(located: DataFrame, files: DataFrame, level: int, start: str, limit: str) -> DataFrame:
    """The versions of a level with start <= key < limit, read from those files only that may hold them."""
    wanted = files.where((F.col("level") == level) & (F.col("smallest") < limit) & (F.col("largest") >= start)).select("number")
    inside = located.where((F.col("level") == level) & (F.col("key") >= start) & (F.col("key") < limit))
    return inside.join(wanted, "number", "left_semi").select("key", "seq", "rtype", "value")
