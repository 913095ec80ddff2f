"""Pruning by key ranges and Bloom filters.

Files have level, number, smallest, largest and file_size. Overlaps are counted by sorted sums, never by pairing ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import LEVELS, bloom_hashes, bloom_positions
from tidemark.functions.order import PARTS, successor, weight_between


def find_table(keys: DataFrame, files: DataFrame, parts: int = PARTS) -> DataFrame:
    """key, level and number of the first file of each level whose largest key is at or after the key."""
    levels = F.explode(F.array(*[F.lit(k) for k in range(LEVELS)]))
    asked = keys.select("key").distinct().select(levels.alias("level"), F.col("key").alias("target"))
    met = successor(asked, files.select("level", F.col("largest").alias("key"), "number"), parts, ["level"], carry="number", sample=keys)
    return met.where("found is not null").select(F.col("target").alias("key"), "level", "number")


def overlap_counts(ranges: DataFrame, files: DataFrame, parts: int = PARTS) -> DataFrame:
    """level, id and n_files: how many files of the level overlap each closed range (level, id, low, high); null bounds are open."""
    spans = files.select("level", F.col("smallest").alias("first"), F.col("largest").alias("last"), F.lit(1).alias("w"))
    return weight_between(ranges.withColumn("closed", F.lit(True)), spans, parts, ["level"]).withColumnRenamed("w", "n_files")


def overlapping(files: DataFrame, level: int, low: str | None, high: str | None) -> DataFrame:
    """The files of a level that overlap [low, high], from the newest number on; null bounds are open."""
    found = files.where(F.col("level") == level)
    if low is not None:
        found = found.where(F.col("largest") >= low)
    if high is not None:
        found = found.where(F.col("smallest") <= high)
    return found.orderBy(F.desc("number"))


def islands(files: DataFrame) -> DataFrame:
    """level, number and island: files of a level that hang together by overlaps, numbered by their smallest keys.

    A range widened to all files that it meets, again and again, ends as its island.
    """
    order = Window.partitionBy("level").orderBy("smallest", "number")
    reach = F.max("largest").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = files.withColumn("gap", F.coalesce(F.col("smallest") > reach, F.lit(True)).cast("int"))
    return gap.select("level", "number", F.sum("gap").over(order).alias("island"))


def widened(files: DataFrame, low: str | None, high: str | None) -> DataFrame:
    """The files of level 0 that overlap [low, high], that range being widened by each of them until nothing is added."""
    own = islands(files.where("level = 0")).select("number", "island")
    files = files.join(own, "number")
    spans = files.groupBy("island").agg(F.min("smallest").alias("from"), F.max("largest").alias("to"))
    if low is not None:
        spans = spans.where(F.col("to") >= low)
    if high is not None:
        spans = spans.where(F.col("from") <= high)
    return files.where("level = 0").join(spans.select("island"), "island", "left_semi").drop("island")


def bloom_bits(keys: DataFrame, slot: str, bits_per_key: int = 10) -> DataFrame:
    """slot, n_bits and bit: the bits set in the filter of each slot by its distinct keys (slot, key)."""
    keys = keys.select(slot, "key").distinct()
    sizes = keys.groupBy(slot).agg(F.greatest(F.count("*") * bits_per_key, F.lit(64)).alias("n_bits"))
    hashes = bloom_hashes(bits_per_key)
    return keys.join(sizes, slot).select(slot, "n_bits", F.explode(bloom_positions(F.col("key"), F.col("n_bits"), hashes)).alias("bit")).distinct()


def bloom_probe(probes: DataFrame, bits: DataFrame, slot: str, bits_per_key: int = 10) -> DataFrame:
    """slot, key and may_match of each distinct probe (slot, key); a slot without a filter matches nothing."""
    probes = probes.select(slot, "key").distinct()
    sizes = bits.groupBy(slot).agg(F.max("n_bits").alias("n_bits"))
    asked = probes.join(sizes, slot).select(slot, "key", F.explode(F.array_distinct(bloom_positions(F.col("key"), F.col("n_bits"), bloom_hashes(bits_per_key)))).alias("bit"))
    met = asked.join(bits.select(slot, "bit", F.lit(1).alias("is_set")), [slot, "bit"], "left").groupBy(slot, "key").agg((F.count("is_set") == F.count("*")).alias("m"))
    return probes.join(met, [slot, "key"], "left").select(slot, "key", F.coalesce("m", F.lit(False)).alias("may_match"))


def filter_slots(keys: DataFrame, base: int = 2048) -> DataFrame:
    """slot and n_keys: distinct keys by the part of ``base`` bytes that their block's offset (offset, key) falls in."""
    return keys.groupBy(F.floor(F.col("offset") / base).alias("slot")).agg(F.countDistinct("key").alias("n_keys"))
