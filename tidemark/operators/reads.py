"""Reads over versions: newest values, snapshots, ordered scans and cursors.

Versions have key, seq, rtype (0 put, 1 delete) and value. A key's delete marker hides its older versions, and a deleted
key reads like one that never was. Conditions on keys and sequence numbers are plain filters, so that Parquet skips
what they exclude.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import packed_order
from tidemark.functions.order import PARTS, heavy_keys, next_and_previous, part_of, successor


def newest(versions: DataFrame) -> DataFrame:
    """The newest version of each key, delete markers included: the largest seq, then the largest rtype.

    One hash aggregation with partial sums before the shuffle: the order (seq, rtype) is packed in a long.
    """
    order = packed_order(F.col("seq"), F.col("rtype"))
    best = versions.groupBy("key").agg(F.max(order).alias("o"), F.max_by("value", order).alias("value"))
    return best.select("key", F.shiftright("o", 2).alias("seq"), F.col("o").bitwiseAND(3).cast("int").alias("rtype"), "value")


def live(versions: DataFrame) -> DataFrame:
    """key, seq and value of each key whose newest version isn't a delete marker."""
    return newest(versions).where("rtype = 0").select("key", "seq", "value")


def live_at(versions: DataFrame, snapshot: int) -> DataFrame:
    """The live view as of a sequence number."""
    return live(versions.where(F.col("seq") <= snapshot))


def get(versions: DataFrame, key: str, snapshot: int | None = None) -> DataFrame:
    """The live value of one key, now or as of a sequence number: one row or none."""
    of_key = versions.where(F.col("key") == key)
    return live(of_key) if snapshot is None else live_at(of_key, snapshot)


def multi_get(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """key, found, seq and value for each distinct key of ``keys``."""
    keys = keys.select("key").distinct()
    got = live(versions.join(keys, "key", "left_semi"))
    return keys.join(got, "key", "left").select("key", F.col("seq").isNotNull().alias("found"), "seq", "value")


def get_as_of(versions: DataFrame, probes: DataFrame, parts: int = PARTS) -> DataFrame:
    """key, snapshot, seq and value of each probe (key, snapshot) whose key is live as of the snapshot.

    An as-of join by one window over both tables, so that a key's versions are never paired with all of its probes. Keys
    with a ``parts``-th or more of the rows are cut into ranges of sequence numbers, and the last version of each range is
    carried to the next ones; there are fewer than 2 * ``parts`` such ranges, whatever the tables' size. Repeated probes
    give repeated rows.
    """
    rows = versions.select("key", F.col("seq").cast("long").alias("seq"), F.struct("seq", "rtype", "value").alias("v"), F.lit(0).alias("probe"))
    asked = probes.select("key", F.col("snapshot").cast("long").alias("seq"), F.lit(None).cast(rows.schema["v"].dataType).alias("v"), F.lit(1).alias("probe"))
    both = rows.unionByName(asked)
    heavy = heavy_keys(both, "key", "seq", parts)
    part = F.lit(0)
    for key, cuts in heavy.items():
        part = F.when(F.col("key") == F.lit(key), part_of("seq", cuts)).otherwise(part)
    both = both.withColumn("part", part)
    before = Window.partitionBy("key", "part").orderBy("seq", "probe", "v.rtype").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("last", F.last("v", ignorenulls=True).over(before)).where("probe = 1")
    if heavy:
        order = F.when(F.col("probe") == 0, F.struct("seq", "v.rtype"))
        ranges = both.where(F.col("key").isin(list(heavy))).groupBy("key", "part").agg(F.max_by("v", order).alias("end"))
        earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        carried = ranges.select("key", "part", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
        met = met.join(F.broadcast(carried), ["key", "part"], "left").withColumn("last", F.coalesce("last", "carried"))
    return met.where("last.rtype = 0").select("key", F.col("seq").alias("snapshot"), F.col("last.seq").alias("seq"), F.col("last.value").alias("value"))


def scan(versions: DataFrame, start: str | None = None, limit: str | None = None) -> DataFrame:
    """The live rows with start <= key < limit; null bounds are open."""
    if start is not None:
        versions = versions.where(F.col("key") >= start)
    if limit is not None:
        versions = versions.where(F.col("key") < limit)
    return live(versions)


def prefix_scan(versions: DataFrame, prefix: str) -> DataFrame:
    """The live rows whose key starts with ``prefix``."""
    return live(versions.where(F.col("key").startswith(prefix)))


def ordered(versions: DataFrame, start: str | None = None, limit: str | None = None, reverse: bool = False) -> DataFrame:
    """The live rows with start <= key < limit in the order of their keys, or backwards: what a cursor walks."""
    return scan(versions, start, limit).orderBy(F.desc("key") if reverse else F.asc("key"))


def get_by_level(located: DataFrame, keys: DataFrame, snapshot: int | None = None) -> DataFrame:
    """key, level, number, seq and value of each of ``keys`` (key) that is live, by a look-up from level to level.

    ``located`` are versions with the level and the number of their file. Level 0 is asked first, there the newest file
    (the largest number) first, then the levels below; the first file with a version of the key decides, by its newest
    version, and a delete marker ends the search. It is one aggregation with partial sums, not a pass for each level.
    """
    if snapshot is not None:
        located = located.where(F.col("seq") <= snapshot)
    place = F.struct("level", F.when(F.col("level") == 0, -F.col("number")).otherwise(0).alias("age"), (-packed_order(F.col("seq"), F.col("rtype"))).alias("o"))
    wanted = located.join(keys.select("key").distinct(), "key", "left_semi")
    first = wanted.groupBy("key").agg(F.min_by(F.struct("level", "number", "seq", "rtype", "value"), place).alias("v"))
    return first.where("v.rtype = 0").select("key", "v.level", "v.number", "v.seq", "v.value")


def seek(versions: DataFrame, targets: DataFrame, parts: int = PARTS) -> DataFrame:
    """target and found: the first live key at or after each of ``targets`` (target), null past the end."""
    return successor(targets.select("target"), live(versions).select("key"), parts, sample=versions)


def ends(versions: DataFrame) -> DataFrame:
    """first_key and last_key of the live view."""
    return live(versions).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def neighbours(versions: DataFrame, parts: int = PARTS) -> DataFrame:
    """key, next_key and prev_key of each live key."""
    return next_and_previous(live(versions), parts, versions)


def contains(versions: DataFrame, keys: DataFrame) -> DataFrame:
    """key and present for each distinct key of ``keys``: whether it has any version, markers included."""
    has = versions.select("key").distinct().withColumn("has", F.lit(True))
    return keys.select("key").distinct().join(has, "key", "left").select("key", F.coalesce("has", F.lit(False)).alias("present"))


def dump(versions: DataFrame) -> DataFrame:
    """All versions, markers included, by key and from the newest to the oldest."""
    return versions.orderBy("key", F.desc("seq"), F.desc("rtype"))


def last_sequence(versions: DataFrame) -> DataFrame:
    """last_seq: the largest sequence number, 0 without versions. A reader keeps it as its snapshot."""
    return versions.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last_seq"))
