"""Write batches: ordered puts and deletes that get consecutive sequence numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.order import PARTS, weight_below


def counts(batches: DataFrame) -> DataFrame:
    """batch_id and n_ops of each batch (batch_id, ops)."""
    return batches.select("batch_id", F.size("ops").alias("n_ops"))


def append(batches: DataFrame, group: int = 2) -> DataFrame:
    """Groups of ``group`` batches as one each, in order: batch_id (of the group) and ops."""
    members = batches.groupBy(F.floor(F.col("batch_id") / group).alias("group_id")).agg(F.array_sort(F.collect_list(F.struct("batch_id", "ops"))).alias("m"))
    return members.select(F.col("group_id").alias("batch_id"), F.flatten(F.transform("m", lambda x: x.ops)).alias("ops"))


def errors(batches: DataFrame) -> DataFrame:
    """batch_id and error of each malformed batch (batch_id, ops and, if it is there, n_ops): the first that applies.

    The count differs from the ops' number; an op is neither put nor delete; an op is without a key.
    """
    wrong = (F.col("n_ops") != F.size("ops")) if "n_ops" in batches.columns else F.lit(False)
    kind = F.exists("ops", lambda o: o.rtype.isNull() | ~o.rtype.isin(0, 1))
    error = F.when(F.col("ops").isNull() | wrong, "count").when(kind, "type").when(F.exists("ops", lambda o: o.key.isNull()), "key")
    return batches.select("batch_id", error.alias("error")).where("error is not null")


def apply(batches: DataFrame, last_seq: int = 0, parts: int = PARTS) -> DataFrame:
    """The batches' ops as versions: the k-th op after ``last_seq``, over all batches in order, gets last_seq + k.

    An op that is neither put nor delete, or has no key, fails the job that reads its rtype; null ops are none. The
    running count goes over a row for each batch, in ranges of batch ids.
    """
    sizes = batches.select(F.col("batch_id").alias("key"), F.coalesce(F.size("ops"), F.lit(0)).alias("w"))
    bases = weight_below(sizes.select(F.col("key").alias("id"), "key", F.lit(False).alias("at_key")), sizes, parts)
    bases = bases.select(F.col("id").alias("batch_id"), (F.col("below") + last_seq + 1).alias("base"))
    ops = batches.join(bases, "batch_id").select("batch_id", "base", F.posexplode("ops").alias("at", "op"))
    error = F.raise_error(F.concat(F.lit("malformed batch "), F.col("batch_id").cast("string"))).cast("int")
    rtype = F.when(F.col("op.key").isNotNull() & F.col("op.rtype").isin(0, 1), F.col("op.rtype")).otherwise(error)
    return ops.select("op.key", (F.col("base") + F.col("at")).alias("seq"), rtype.alias("rtype"), "op.value")


def distinct_versions(versions: DataFrame) -> DataFrame:
    """Versions without repeats of (key, seq, rtype); of different values the smallest stays."""
    return versions.groupBy("key", "seq", "rtype").agg(F.min("value").alias("value"))


def memory_usage(versions: DataFrame, value_bytes: int = 8) -> DataFrame:
    """usage: bytes of keys and values, and 16 for each version."""
    size = F.octet_length("key") + F.when(F.col("value").isNotNull(), value_bytes).otherwise(0) + 16
    return versions.agg(F.coalesce(F.sum(size), F.lit(0)).alias("usage"))
