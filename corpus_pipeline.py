"""The corpus pipeline: quality rules, quality classifier, near-duplicates and packing, each over what the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import order_minhash, packing, quality_classifier, quality_rules
from tidemark.llm.common import Scratch, fresh, materialise, table
from tidemark.llm.text_stats import text_stats


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest.

    Null, empty and short texts fail. Rows that repeat are judged alike, and columns stay as they are, whatever their
    names. An empty table gives an empty result.
    """
    scratch = Scratch(spark, "rules-counts")
    forest = quality_rules.fit(scratch.table(text_stats(docs), "counts"), table(spark, sf_dir, "labels"))
    scratch.remove()
    return quality_rules.keep_rows(docs, forest)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant scores 0.5 or more, a text without words by what it scores.

    Rows that repeat are scored alike, and columns stay as they are, whatever their names. An empty table gives an
    empty result; without labels every document stays.
    """
    labels = table(spark, sf_dir, "labels")
    model = quality_classifier.fit(text_stats(docs), labels.where(~quality_classifier.held_out(labels["doc_id"])))
    return quality_classifier.keep_rows(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest doc_id (null ones last).

    Documents are told apart by doc_id and text, so that two texts with one doc_id are compared like any others. Of rows
    that repeat both, one stays. Null and empty texts, and those of white space only, are classes of their own. Columns
    stay as they are, whatever their names. An empty table gives an empty result.
    """
    own = fresh("own", *docs.columns)
    keyed = docs.withColumn(own, F.xxhash64("doc_id", "text"))
    rows = keyed.groupBy(F.col(own).alias("own")).agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    classes = order_minhash.near_duplicates(keyed.select(F.col(own).alias("doc_id"), "text")).select(F.col("doc_id").alias("own"), "class_id").distinct()
    first = classes.join(rows, "own").groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("without"), "id", "own", "n")).alias("first"))
    kept = first.select("first.own", F.lit(True).alias("stays"))
    changed = rows.join(kept, "own", "left").where("stays is null or n > 1")  # few beside the rest, so that these are what is joined with the texts
    changed = materialise(changed.select(F.col("own").alias(own), F.coalesce("stays", F.lit(False)).alias("stays")), "dedup-changed")
    once = keyed.join(changed.select(own), own, "left_anti")
    repeated = keyed.join(changed.where("stays").select(own), own, "left_semi").dropDuplicates([own])
    return once.unionByName(repeated).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of the documents in sequences of 2048 tokens.

    A null text is an empty one. Rows that repeat are packed each; further columns are left out. An empty table gives an
    empty result.
    """
    pieces = packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.best_fit(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("order_minhash", near_dedup), ("best_fit_packing", pack)]

#: SQL can express neither a forest and a discriminant fitted on the data, nor tokenization; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
