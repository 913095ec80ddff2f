"""Ordered look-ups over a whole table of keys without a pass through one task.

Keys are dealt to ranges between split points, which are taken from a bounded sample of the keys. Rows are sorted within
their ranges, and a summary with a row for each range carries results from range to range. ``parts`` says how many ranges
there are at most; it never changes a result, nor does ``sample``, a table with the column key to take the sample from
where the keys themselves are the outcome of a long computation. Keys are strings, or longs where ``sentinels`` aren't needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 64
SAMPLE_KEYS = 4096
#: A key after all others, for ranges without an end.
LAST = "\U0010ffff"


def _literal(x: str | int) -> str:
    if isinstance(x, int):
        return f"{x}L"
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def split_points(df: DataFrame, key: str, parts: int = PARTS, sample_keys: int = SAMPLE_KEYS) -> list:
    """At most ``parts`` - 1 keys that cut the distinct keys of ``df`` into even ranges: quantiles of ``sample_keys`` of them.

    Each of the sample's keys is the one of the largest hash in its bucket of keys, so the sample doesn't depend on how
    the table is dealt to tasks.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(sample_keys))
    found = df.where(F.col(key).isNotNull()).groupBy(bucket.alias("b")).agg(F.max_by(key, F.xxhash64(F.lit(1), key)).alias("k")).collect()
    keys = sorted({r.k for r in found})
    cuts = [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []
    return sorted(set(cuts))


def part_of(key: str, cuts: list) -> Column:
    """The number of a key's range, by a binary search through the cuts; a null key is in the first."""

    def tree(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"CASE WHEN `{key}` >= {_literal(cuts[mid])} THEN {tree(mid + 1, high)} ELSE {tree(low, mid)} END"

    return F.expr(tree(0, len(cuts)))


def heavy_keys(rows: DataFrame, key: str, at: str, parts: int = PARTS, sample_rows: int = SAMPLE_KEYS) -> dict:
    """Cuts of ``at`` (a long) for each key with a ``parts``-th or more of the distinct (key, at): fewer than 2 * ``parts`` ranges in all.

    Shares and cuts are those of a sample of at most ``sample_rows`` rows, the row of the largest hash in each bucket.
    """
    bucket = F.pmod(F.xxhash64(key, at), F.lit(sample_rows))
    one = F.max_by(F.struct(F.col(key).alias("key"), F.col(at).alias("at")), F.xxhash64(F.lit(1), key, at))
    found = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(bucket.alias("b")).agg(one.alias("r")).collect()
    seen: dict = {}
    for r in found:
        seen.setdefault(r.r.key, []).append(r.r["at"])
    heavy = {}
    for k, places in seen.items():
        n = len(places) * parts // len(found)
        if n >= 1 and len(places) > 1:
            places.sort()
            heavy[k] = sorted({places[len(places) * i // (n + 1)] for i in range(1, n + 1)})
    return heavy


def next_and_previous(keys: DataFrame, parts: int = PARTS, sample: DataFrame | None = None) -> DataFrame:
    """key, next_key and prev_key of each distinct key of ``keys``; null at the ends."""
    keys = keys.select("key").where("key is not null").distinct()
    keys = keys.withColumn("__part", part_of("key", split_points(sample or keys, "key", parts)))
    own, all_parts = Window.partitionBy("__part").orderBy("key"), Window.orderBy("__part")  # a row for each range
    ends = keys.groupBy("__part").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    ends = ends.select("__part", F.lead("low").over(all_parts).alias("after"), F.lag("high").over(all_parts).alias("before"))
    near = keys.select("*", F.lead("key").over(own).alias("n"), F.lag("key").over(own).alias("p"))
    return near.join(F.broadcast(ends), "__part").select("key", F.coalesce("n", "after").alias("next_key"), F.coalesce("p", "before").alias("prev_key"))


def successor(targets: DataFrame, keys: DataFrame, parts: int = PARTS, by: list[str] | None = None, carry: str | None = None, sample: DataFrame | None = None) -> DataFrame:
    """``targets`` (by and target) with found: the smallest key of ``keys`` (by and key) at or after each target, or null.

    ``carry`` names a column of ``keys`` to give back with the key; of equal keys, the one with its smallest value is found.
    ``by`` has few values, such as levels.
    """
    by = by or []
    extra = F.col(carry) if carry else F.lit(None).cast("long")
    found = keys.select(*by, "key", F.struct("key", extra.alias("extra")).alias("k"))
    both = found.unionByName(targets.select(*by, F.col("target").alias("key")).withColumn("k", F.lit(None).cast(found.schema["k"].dataType)))
    both = both.withColumn("__part", part_of("key", split_points(sample or keys, "key", parts)))
    # backwards, as Spark evaluates frames that grow in one pass, but those that shrink anew for each row
    own = Window.partitionBy(*by, "__part").orderBy(F.desc("key")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(*by).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    firsts = both.groupBy(*by, "__part").agg(F.min("k").alias("low")).select(*by, "__part", F.min("low").over(later).alias("after"))
    at = both.withColumn("own", F.min("k").over(own)).where("k is null")
    met = at.join(F.broadcast(firsts), [*by, "__part"]).withColumn("found", F.coalesce("own", "after"))
    return met.select(*by, F.col("key").alias("target"), F.col("found.key").alias("found"), *([F.col("found.extra").alias(carry)] if carry else []))


def _running(rows: DataFrame, sums: list[str], parts: int, by: list[str], sample: DataFrame) -> DataFrame:
    """``rows`` (by, key, rank, and the columns ``sums``) with each sum over the rows up to (key, rank) in place of the row's own."""
    rows = rows.withColumn("__part", part_of("key", split_points(sample, "key", parts)))
    own = Window.partitionBy(*by, "__part").orderBy("key", "rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = rows.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before = before.select(*by, "__part", *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}") for c in sums])
    return rows.withColumns({c: F.sum(c).over(own) for c in sums}).join(F.broadcast(before), [*by, "__part"]).withColumns({c: F.col(c) + F.col(f"__{c}") for c in sums})


def weight_below(points: DataFrame, weights: DataFrame, parts: int = PARTS, by: list[str] | None = None, sample: DataFrame | None = None) -> DataFrame:
    """``points`` (by, id, key, at_key) with below: the sum of w over ``weights`` (by, key, w) with a smaller key.

    Where at_key is true, keys equal to the point's count too. A null point is below all keys.
    """
    by = by or []
    rank = F.when(F.col("at_key"), 2).otherwise(0)
    asked = points.select(*by, "id", "key", rank.alias("rank"), F.lit(0).cast("long").alias("below"))
    both = asked.unionByName(weights.select(*by, F.lit(None).cast(asked.schema["id"].dataType).alias("id"), "key", F.lit(1).alias("rank"), F.col("w").cast("long").alias("below")))
    return _running(both, ["below"], parts, by, sample or points).where("rank <> 1").select(*by, "id", "below")


def weight_between(ranges: DataFrame, spans: DataFrame, parts: int = PARTS, by: list[str] | None = None) -> DataFrame:
    """by, id and w: the weight of all ``spans`` (by, first, last, w) that overlap each range (by, id, low, high, closed).

    What overlaps is what starts before the range's end, without what ends before its start; both are read off in one
    pass. A null low is before all keys; a null high, after. ids are distinct within ``by``. The split points are taken from
    the ranges, which are many beside the spans.
    """
    by = by or []
    ends = F.array(F.struct(F.col("first").alias("key"), F.col("w").cast("long").alias("begun"), F.lit(0).cast("long").alias("over")), F.struct(F.col("last").alias("key"), F.lit(0).cast("long").alias("begun"), F.col("w").cast("long").alias("over")))
    weights = spans.select(*by, F.inline(ends)).withColumns({"rank": F.lit(1), "id": F.lit(None).cast(ranges.schema["id"].dataType)})
    none = F.lit(0).cast("long")
    asked = F.array(F.struct(F.coalesce("low", F.lit("")).alias("key"), F.lit(0).alias("rank"), none.alias("begun"), none.alias("over")), F.struct(F.coalesce("high", F.lit(LAST)).alias("key"), F.when(F.col("closed") | F.col("high").isNull(), 2).otherwise(3).alias("rank"), none.alias("begun"), none.alias("over")))
    points = ranges.select(*by, "id", F.inline(asked))
    # an open end comes before what starts at it; 3 tells it from the start, and sorts as -1
    points = points.withColumn("open", F.col("rank") == 3).withColumn("rank", F.when(F.col("open"), -1).otherwise(F.col("rank")))
    met = _running(points.unionByName(weights.withColumn("open", F.lit(False))), ["begun", "over"], parts, by, ranges.select(F.coalesce("low", "high").alias("key"))).where("rank <> 1")
    is_end = F.col("rank") != 0
    return met.groupBy(*by, "id").agg((F.sum(F.when(is_end, F.col("begun"))) - F.sum(F.when(~is_end, F.col("over")))).alias("w"))
