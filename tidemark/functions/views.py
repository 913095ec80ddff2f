"""The driver's tables seen as versions: (key, seq, rtype, value) rows, with runs, batches, file metadata and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PUT, DELETE = 0, 1


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(prefix: str, number: str, width: int) -> F.Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(number).cast("string"), width, "0"))


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version for each event: a user's error deletes the key, any other event puts its value."""
    return load(spark, sf_dir, "events").select(
        _padded("user", "user_id", 8).alias("key"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(F.col("event_type") == "error", DELETE).otherwise(PUT).alias("rtype"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )


def lineitem_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version of its part for each line item; a few (key, seq) repeat."""
    return load(spark, sf_dir, "lineitem").select(
        _padded("p", "l_partkey", 8).alias("key"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.when(F.col("l_returnflag") == "R", DELETE).otherwise(PUT).alias("rtype"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("value"),
    )


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One put for each order."""
    return load(spark, sf_dir, "orders").select(_padded("o", "o_orderkey", 10).alias("key"), (F.col("o_orderkey") + 1).alias("seq"), F.lit(PUT).alias("rtype"), F.col("o_totalprice").alias("value"))


def runs(spark: SparkSession, sf_dir: str, n: int = 4) -> list[DataFrame]:
    """The events' versions as ``n`` runs, dealt by seq."""
    versions = event_versions(spark, sf_dir)
    return [versions.where((F.col("seq") - 1) % n == k) for k in range(n)]


def batches(spark: SparkSession, sf_dir: str, size: int = 100) -> DataFrame:
    """batch_id and ops (an array of structs in order) of write batches of ``size`` events each."""
    v = event_versions(spark, sf_dir)
    op = F.struct("seq", "rtype", "key", "value")
    grouped = v.groupBy(F.floor((F.col("seq") - 1) / size).alias("batch_id")).agg(F.array_sort(F.collect_list(op)).alias("ops"))
    return grouped.select("batch_id", F.transform("ops", lambda o: F.struct(o.rtype.alias("rtype"), o.key.alias("key"), o.value.alias("value"))).alias("ops"))


def faulty_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_id, ops and n_ops of the events' batches, of which some have a wrong count, an unknown type or no key."""
    e = load(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 1511 != 7, _padded("user", "user_id", 8))
    op = F.struct("event_id", F.when(F.col("event_id") % 1103 == 5, 7).otherwise(PUT).alias("rtype"), key.alias("key"), "value")
    grouped = e.groupBy(F.expr("event_id div 100").alias("batch_id")).agg(F.array_sort(F.collect_list(op)).alias("ops"))
    return grouped.withColumn("n_ops", F.size("ops") + (F.col("batch_id") % 10 == 3).cast("int"))


def located_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' versions with the number and the level of the file that holds each."""
    number = F.floor((F.col("seq") - 1) / 2500) * 40 + F.floor(F.substring("key", 5, 8).cast("long") / 7)
    return event_versions(spark, sf_dir).withColumn("number", number).withColumn("level", (F.col("number") % 3).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """level, number, smallest, largest and file_size of the files, a row each."""
    return located_versions(spark, sf_dir).groupBy("level", "number").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), (F.count("*") * 100).alias("file_size"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edit_id, phase (0 delete, 1 add), level, number: files are added, every fifth deleted later, every tenth added again."""
    f = files(spark, sf_dir)
    row = lambda d, at, phase: d.select((F.col("number") + at).alias("edit_id"), F.lit(phase).alias("phase"), "level", "number", "file_size")
    return row(f, 0, 1).unionByName(row(f.where("number % 5 = 0"), 37, 0)).unionByName(row(f.where("number % 10 = 0"), 60, 1))
