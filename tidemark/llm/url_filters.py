"""URL filters by a temporal list join, in DataFrame functions only.

A list is a log of dated entries: a pattern (a domain, with an optional path) is added to or removed from a list that
blocks or allows. Each pattern's log becomes validity intervals. A capture is judged by the entries that were active
when it was fetched: of those whose domain is its host or a parent of it, and whose path is a prefix of its path at a
segment's end, the most specific one decides (the longest domain, then the longest path); at a tie an allowing entry,
then the smaller list name.

Patterns are matched with the distinct hosts, which are few beside the captures; then captures meet the rules of their
host in an equi-join with the dates as a condition. The rules are a table of their own by then, so that Spark can split
a host that holds a large part of all captures.

Defined results: a null, empty or malformed URL has an empty host and isn't blocked; nor is a capture without a fetch
date. Letter case is ignored in hosts only. Entries with a null pattern or date are left out; an addition and a removal
of one day leave the pattern off. Repeated captures are judged each; repeated entries count once. Further columns of
``captures`` are carried through, unless they are named like a column of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a final dot; empty if there is none."""
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)), F.lit("."))


def path_of(url: Column) -> Column:
    """The path of a URL, from its slash up to a query or fragment; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """list_name, verdict, domain, path, valid_from and valid_to (exclusive, null: open) from dated entries.

    ``entries``: list_name, verdict ('block' or 'allow'), pattern, action ('add' or 'remove'), listed_on.
    """
    log = entries.where("pattern is not null and listed_on is not null and action in ('add', 'remove')").select("list_name", "verdict", "pattern", "action", "listed_on").distinct()
    order = Window.partitionBy("list_name", "verdict", "pattern").orderBy("listed_on", "action")
    spans = log.withColumn("valid_to", F.lead("listed_on").over(order)).where("action = 'add' and (valid_to is null or valid_to > listed_on)")
    domain = F.rtrim(F.lower(F.substring_index("pattern", "/", 1)), F.lit("."))
    path = F.rtrim(F.expr("substring(pattern, length(substring_index(pattern, '/', 1)) + 1)"), F.lit("/"))
    return spans.select("list_name", "verdict", domain.alias("domain"), path.alias("path"), F.col("listed_on").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """``captures`` with host, blocked and rule (the deciding list and pattern, null if none was active)."""
    kept = [c for c in captures.columns if c not in ("host", "blocked", "rule")]
    at = captures.select(*kept).withColumn("host", host_of(F.col(url)))
    hosts = at.select("host").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    parents = hosts.withColumn("__labels", labels).withColumn("domain", F.explode(F.transform(F.sequence(F.lit(1), F.size("__labels")), lambda i: F.array_join(F.slice("__labels", i, F.size("__labels")), "."))))
    rules = materialise(parents.select("host", "domain").join(intervals(entries), "domain"), "url-rules")

    seen = at.where("host <> ''").select(F.col("host"), F.col(url).alias("__url"), F.col(fetched).alias("__on")).distinct()
    path = path_of(F.col("__url"))
    active = (F.col("valid_from") <= F.col("__on")) & (F.col("valid_to").isNull() | (F.col("__on") < F.col("valid_to")))
    below = (F.col("path") == "") | (F.col("__path") == F.col("path")) | F.col("__path").startswith(F.concat("path", F.lit("/")))
    met = seen.withColumn("__path", path).join(rules, "host").where(active & below)
    rank = F.struct((-F.length("domain")).alias("d"), (-F.length("path")).alias("p"), (F.col("verdict") != "allow").alias("block"), "list_name", F.concat("domain", "path").alias("pattern"))
    best = met.groupBy("__url", "__on").agg(F.min(rank).alias("__best"))
    best = best.select("__url", "__on", F.col("__best.block").alias("__blocked"), F.concat("__best.list_name", F.lit(":"), "__best.pattern").alias("__rule"))
    out = at.join(best, (at[url] == best["__url"]) & (at[fetched] == best["__on"]), "left")
    return out.select(*[at[c] for c in kept], at["host"], F.coalesce(best["__blocked"], F.lit(False)).alias("blocked"), best["__rule"].alias("rule"))
