"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe_automaton, embedding_dedup, html_extract, order_minhash, packing, quality_classifier, quality_rules, token_counts, url_filters, warc
from tidemark.llm.common import materialise, table
from tidemark.llm.text_stats import text_stats


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(text_stats(table(spark, sf_dir, "documents")), "op1-stats")
    labels = table(spark, sf_dir, "labels")
    model = quality_classifier.fit(stats, labels.where(~quality_classifier.held_out(labels["doc_id"])))
    return quality_classifier.score_stats(stats, model)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialise(text_stats(table(spark, sf_dir, "documents")), "op3-stats")
    return quality_rules.judge_stats(stats, quality_rules.fit(stats, table(spark, sf_dir, "labels")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.best_fit(digests)


def url_lists(pages: DataFrame) -> DataFrame:
    """The dated list that op4 joins: the tables bring none, so entries are derived from the hosts' hashes.

    Hosts by their hash are blocked from a day of 2024 on, and some of them taken off the list 64 days later; some hosts'
    /en pages are allowed from another day on; one whole domain is blocked for a month.
    """
    h = F.md5("host")
    digits = lambda at, n: F.conv(F.substring(h, at, n), 16, 10).cast("int")
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host <> ''").distinct().select("host", h.alias("h"), digits(2, 2).alias("day"), digits(6, 2).alias("day2"))
    row = lambda name, verdict, pattern, action, on: [F.lit(name).alias("list_name"), F.lit(verdict).alias("verdict"), pattern.alias("pattern"), F.lit(action).alias("action"), on.alias("listed_on")]
    start = F.lit("2024-01-01").cast("date")
    blocked = hosts.where("substring(h, 1, 1) < '6'")
    added = blocked.select(*row("hosts", "block", F.col("host"), "add", F.date_add(start, F.col("day"))))
    removed = blocked.where("substring(h, 4, 1) < '8'").select(*row("hosts", "block", F.col("host"), "remove", F.date_add(start, F.col("day") + 64)))
    allowed = hosts.where("substring(h, 5, 1) < '4'").select(*row("paths", "allow", F.concat("host", F.lit("/en")), "add", F.date_add(start, F.col("day2"))))
    fixed = pages.sparkSession.createDataFrame(
        [("domains", "block", "example.net", "add", "2024-06-01"), ("domains", "block", "example.net", "remove", "2024-07-01"), ("domains", "block", "example.com/de", "add", "2024-03-01")],
        "list_name string, verdict string, pattern string, action string, listed_on string",
    ).withColumn("listed_on", F.col("listed_on").cast("date"))
    return added.unionByName(removed).unionByName(allowed).unionByName(fixed)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int"))
    judged = url_filters.evaluate(pages.withColumn("fetched_on", day), materialise(url_lists(pages), "op4-entries"))
    return judged.select("page_id", "url", "host", "blocked", "rule")


ORACLE_OP4 = """
WITH p AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS DATE) AS d,
    rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '.') AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages
), h AS (
  SELECT host, md5(host) AS m, CAST('0x' || substr(md5(host), 2, 2) AS INT) AS day, CAST('0x' || substr(md5(host), 6, 2) AS INT) AS day2
  FROM (SELECT DISTINCT host FROM p WHERE host <> '') AS x
), r AS (
  SELECT 'hosts' AS list_name, 'block' AS verdict, host AS dom, '' AS pre, CAST(DATE '2024-01-01' + day AS DATE) AS f,
    CASE WHEN substr(m, 4, 1) < '8' THEN CAST(DATE '2024-01-01' + day + 64 AS DATE) ELSE DATE '9999-01-01' END AS t
  FROM h WHERE substr(m, 1, 1) < '6'
  UNION ALL SELECT 'paths', 'allow', host, '/en', CAST(DATE '2024-01-01' + day2 AS DATE), DATE '9999-01-01' FROM h WHERE substr(m, 5, 1) < '4'
  UNION ALL SELECT 'domains', 'block', 'example.net', '', DATE '2024-06-01', DATE '2024-07-01'
  UNION ALL SELECT 'domains', 'block', 'example.com', '/de', DATE '2024-03-01', DATE '9999-01-01'
), e AS (
  SELECT p.page_id, p.url, p.host, r.list_name, r.verdict, r.dom, r.pre,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.dom) DESC, length(r.pre) DESC, r.verdict, r.list_name) AS k
  FROM p LEFT JOIN r ON (p.host = r.dom OR ends_with(p.host, '.' || r.dom)) AND p.d >= r.f AND p.d < r.t
    AND (r.pre = '' OR p.path = r.pre OR starts_with(p.path, r.pre || '/'))
)
SELECT page_id, url, host, coalesce(verdict = 'block', FALSE) AS blocked, list_name || ':' || dom || pre AS rule FROM e WHERE k = 1
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    files = warc.write_archives(pages, warc.new_folder(pages), min_bytes=0)
    return warc.read_archives(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_automaton.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filters": op4_url_filters,
    "op5_bpe_automaton": op5_bpe_automaton,
    "op6_warc": op6_warc,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_html_extract": op8_html_extract,
    "op9_token_counts": op9_token_counts,
    "op10_order_minhash": op10_order_minhash,
}
ORACLES: dict[str, str] = {"op4_url_filters": ORACLE_OP4}
