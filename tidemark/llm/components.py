"""Connected components of links, by alternating large and small stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """id and component (the smallest id reachable) of every id in ``links`` (a, b), as a table of ``scratch``.

    Defined results: repeated links and loops are harmless, links with a null end are left out, and an empty table gives
    an empty result. Further columns are ignored.

    Each round writes its edges to the shared folder. Neighbours are only ever aggregated, never gathered, and the
    minima are written before they are joined, so that Spark can split the rows of an id with very many links. It ends
    as soon as the edges are stars: no id both above and below another, none below two.
    """
    spark = links.sparkSession
    edges = scratch.table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    for _ in range(max_rounds):
        ends = edges.select("u", "v", F.lit(0).alias("top")).union(edges.select("v", F.lit(None).cast("long"), F.lit(1)))
        each = ends.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max("top").alias("top"))
        if each.where("low <> high or low is not null and top = 1").count() == 0:
            return scratch.table(each.select(F.col("u").alias("id"), F.coalesce("low", "u").alias("component")), "components")
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star")
        large = scratch.table(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-edges")
        least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.table(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds on {spark.sparkContext.applicationId}")


def merge_classes(classes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``classes`` (id, component; ids without a row are classes of their own) after ``links`` (a, b) between components.

    Only the graph of the classes is worked on, however large they are. Nulls and empty tables are as in
    ``connected_components``.
    """
    merged = connected_components(links, scratch)
    known = classes.union(merged.select("id", F.col("id").alias("component"))).distinct()
    into = merged.select(F.col("id").alias("component"), F.col("component").alias("into"))
    return scratch.table(known.join(into, "component", "left").select("id", F.coalesce("into", "component").alias("component")), "classes")
