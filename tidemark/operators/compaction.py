"""Level-based compaction: scores, choices and rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import L0_TRIGGER, LEVELS, TARGET_FILE_BYTES, level_budget
from tidemark.functions.order import PARTS, weight_below, weight_between
from tidemark.operators.prune import islands, overlap_counts
from tidemark.operators.reads import live, scan


def level_stats(files: DataFrame) -> DataFrame:
    """level, n_files and n_bytes."""
    return files.groupBy("level").agg(F.count("*").alias("n_files"), F.sum("file_size").alias("n_bytes"))


def scores(files: DataFrame) -> DataFrame:
    """level and score of the level most in need: files by the trigger at level 0, bytes by the budget at others but the last.

    At a tie the lower level is chosen. A score of 1 or more asks for a compaction.
    """
    stats = level_stats(files).where(F.col("level") < LEVELS - 1)
    score = F.when(F.col("level") == 0, F.col("n_files") / float(L0_TRIGGER)).otherwise(F.col("n_bytes") / level_budget(F.col("level")))
    return stats.select("level", score.alias("score")).orderBy(F.desc("score"), "level").limit(1)


def pick(files: DataFrame, level: int) -> DataFrame:
    """side (0: the level, 1: the next), number: the level's first file, at level 0 all that hang together with it, and what they overlap."""
    first = files.where(F.col("level") == level).orderBy("smallest", "number").limit(1).select("number")
    chosen = islands(files.where(F.col("level") == 0)).where("island = 1").select("number") if level == 0 else first
    own = files.where(F.col("level") == level).join(chosen, "number", "left_semi")
    span = own.agg(F.min("smallest").alias("low"), F.max("largest").alias("high"))
    below = files.where(F.col("level") == level + 1).join(F.broadcast(span), (F.col("smallest") <= F.col("high")) & (F.col("largest") >= F.col("low")))  # one row
    return own.select(F.lit(0).alias("side"), "number").unionByName(below.select(F.lit(1).alias("side"), "number"))


def level_for_flush(ranges: DataFrame, files: DataFrame, parts: int = PARTS) -> DataFrame:
    """id and level for each flushed range (id, low, high): 0 if level 0 overlaps, else the last of the levels 1 and 2 before an overlap, or 0."""
    each = ranges.withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    n = overlap_counts(each, files, parts).groupBy("id").agg(*[F.max(F.when(F.col("level") == k, F.col("n_files"))).alias(f"n{k}") for k in range(3)])
    return n.select("id", F.when(F.col("n0") > 0, 0).when(F.col("n1") > 0, 0).when(F.col("n2") > 0, 1).otherwise(2).alias("level"))


def next_overlap_bytes(files: DataFrame, parts: int = PARTS) -> DataFrame:
    """most_bytes: over all files of level 1 and below, the most bytes of the next level that one file overlaps."""
    ranges = files.where("level >= 1").select((F.col("level") + 1).alias("level"), F.col("number").alias("id"), F.col("smallest").alias("low"), F.col("largest").alias("high"), F.lit(True).alias("closed"))
    below = files.where("level >= 2")
    spans = below.select("level", F.col("smallest").alias("first"), F.col("largest").alias("last"), F.col("file_size").alias("w"))
    return weight_between(ranges, spans, parts, ["level"]).agg(F.coalesce(F.max("w"), F.lit(0)).alias("most_bytes"))


def rewrite(versions: DataFrame, n_files: int, drop: bool = False) -> DataFrame:
    """The versions range-partitioned by key and sorted within, ready to be written as ``n_files`` files.

    As they are, or with ``drop`` only the live ones, as puts; that is safe where no older level holds their keys.
    """
    rows = live(versions).select("key", "seq", F.lit(0).alias("rtype"), "value") if drop else versions.select("key", "seq", "rtype", "value")
    return rows.repartitionByRange(n_files, "key").sortWithinPartitions("key", F.desc("seq"), F.desc("rtype"))


def cut_by_size(versions: DataFrame, target_bytes: int = TARGET_FILE_BYTES, value_bytes: int = 8, parts: int = PARTS) -> DataFrame:
    """key, seq, rtype, value and file: the number of the file a version goes to, files being filled in the order of keys.

    A file takes the keys whose smaller keys' versions come to its number times ``target_bytes`` or more, and to less
    than the next one's; all versions of a key are in one file. A version counts its key's bytes, ``value_bytes`` if it
    has a value, and 16.
    """
    size = F.octet_length("key") + F.when(F.col("value").isNotNull(), value_bytes).otherwise(0) + 16
    sizes = versions.groupBy("key").agg(F.sum(size).alias("w"))
    below = weight_below(sizes.select(F.col("key").alias("id"), "key", F.lit(False).alias("at_key")), sizes, parts, sample=versions)
    file = F.expr(f"below div {int(target_bytes)}")
    return versions.join(below.select(F.col("id").alias("key"), file.alias("file")), "key").select("key", "seq", "rtype", "value", "file")


def compact_range(versions: DataFrame, begin: str | None, end: str | None) -> DataFrame:
    """All versions, but of keys in the closed range [begin, end] only live ones; null bounds are open."""
    inside = (F.lit(True) if begin is None else F.col("key") >= begin) & (F.lit(True) if end is None else F.col("key") <= end)
    kept = scan(versions.where(inside)).select("key", "seq", F.lit(0).alias("rtype"), "value")
    return kept.unionByName(versions.where(~inside).select("key", "seq", "rtype", "value"))
