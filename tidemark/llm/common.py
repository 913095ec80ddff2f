"""Helpers that the corpus operators share: tables, shared storage and schemas."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    It is the one named by spark.checkpoint.dir. Only where that is unset and the master is local, as in tests on one
    machine, a temporary folder is set instead; on a cluster that is an error.
    """
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if set_dir is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        set_dir = sc.getCheckpointDir()
    return set_dir.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: what was computed survives the loss of executors and is never computed again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_uri(path: str) -> str:
    """A path of the shared folder as a URI, for readers and writers outside Spark."""
    if re.match(r"[a-z][a-z0-9+.-]*:/", path):
        return re.sub(r"^file:/+", "file:///", path)
    return f"file://{path}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared ones, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """The intermediate tables of one run, in one folder of the shared ones that is removed when the run's result stands."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path, self.count = spark, name, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as a table of the run and read back."""
        self.count += 1
        path = f"{self.path}/{self.count}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` as a table of its own; the run's others are removed."""
        out = materialise(df, self.name)
        self.remove()
        return out

    def remove(self) -> None:
        """Delete the run's tables."""
        delete(self.spark, self.path)


def fresh(name: str, *taken: str) -> str:
    """A column name that isn't among ``taken``, whatever its letter case."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name
