"""The query catalogue of the version operators, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.functions import views as V
from tidemark.operators import batches, compaction, manifest, merge, prune, reads, stats

EV = """ev AS (SELECT 'user' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, event_id + 1 AS seq,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS rtype, CASE WHEN event_type <> 'error' THEN value END AS value, user_id FROM events)"""
LIVE = f"{EV}, newest AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC, rtype DESC) = 1), live AS (SELECT key, seq, value FROM newest WHERE rtype = 0)"
FL = f"""{EV}, loc AS (SELECT *, ((seq - 1) // 2500) * 40 + user_id // 7 AS number, CAST((((seq - 1) // 2500) * 40 + user_id // 7) % 3 AS INTEGER) AS level FROM ev),
fl AS (SELECT level, number, min(key) AS smallest, max(key) AS largest, count(*) * 100 AS file_size FROM loc GROUP BY level, number)"""
ED = f"""{FL}, ed AS (SELECT number AS edit_id, 1 AS phase, level, number, file_size FROM fl
  UNION ALL SELECT number + 37, 0, level, number, file_size FROM fl WHERE number % 5 = 0
  UNION ALL SELECT number + 60, 1, level, number, file_size FROM fl WHERE number % 10 = 0)"""
SNAPSHOT = 500
LOW, HIGH = "user00000003", "user00000011"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Keys of which some have versions: a key for each customer."""
    return V.load(spark, d, "customer").select(F.concat(F.lit("user"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("key"), "c_custkey")


CU = "cu AS (SELECT 'user' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key, c_custkey FROM customer)"
RANGES = "rg AS (SELECT c_custkey AS id, key AS low, 'user' || lpad(CAST(c_custkey + c_custkey % 13 AS VARCHAR), 8, '0') AS high FROM cu)"


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """A range of keys for each customer."""
    high = F.concat(F.lit("user"), F.lpad((F.col("c_custkey") + F.col("c_custkey") % 13).cast("string"), 8, "0"))
    return customers(spark, d).select(F.col("c_custkey").alias("id"), F.col("key").alias("low"), high.alias("high"))


@query(f"WITH {LIVE} SELECT key, seq, value FROM live")
def latest_live(spark, d):
    return reads.live(V.event_versions(spark, d))


@query(f"WITH {EV} SELECT key, seq, CAST(rtype AS INTEGER) AS rtype, value FROM ev QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def newest_versions(spark, d):
    return reads.newest(V.event_versions(spark, d))


@query(f"WITH {LIVE} SELECT * FROM live WHERE key = 'user00000042'")
def get_key(spark, d):
    return reads.get(V.event_versions(spark, d), "user00000042")


SNAP = f"{EV}, sn AS (SELECT * FROM ev WHERE seq <= {SNAPSHOT} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"


@query(f"WITH {SNAP} SELECT key, seq, value FROM sn WHERE rtype = 0 AND key = 'user00000005'")
def get_at_snapshot(spark, d):
    return reads.get(V.event_versions(spark, d), "user00000005", SNAPSHOT)


@query(f"WITH {SNAP} SELECT key, seq, value FROM sn WHERE rtype = 0")
def snapshot_live(spark, d):
    return reads.live_at(V.event_versions(spark, d), SNAPSHOT)


@query(f"WITH {LIVE}, {CU} SELECT key, seq IS NOT NULL AS found, seq, value FROM cu LEFT JOIN live USING (key)")
def multi_get(spark, d):
    return reads.multi_get(V.event_versions(spark, d), customers(spark, d))


@query(f"""WITH {EV}, pr AS (SELECT key, seq + 7 AS snapshot FROM ev WHERE seq % 10 = 0)
SELECT key, snapshot, seq, value FROM (SELECT pr.key, snapshot, ev.seq, value, rtype, row_number() OVER (PARTITION BY pr.key, snapshot ORDER BY ev.seq DESC) AS k
  FROM pr JOIN ev ON pr.key = ev.key AND ev.seq <= snapshot) AS x WHERE k = 1 AND rtype = 0""")
def asof_get(spark, d):
    v = V.event_versions(spark, d)
    return reads.get_as_of(v, v.where("seq % 10 = 0").select("key", (F.col("seq") + 7).alias("snapshot")))


@query(f"WITH {LIVE} SELECT * FROM live WHERE key >= '{LOW}' AND key < '{HIGH}'")
def range_scan(spark, d):
    return reads.scan(V.event_versions(spark, d), LOW, HIGH)


@query("SELECT 'o' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_orderkey + 1 AS seq, o_totalprice AS value FROM orders WHERE 'o' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') LIKE 'o00000001%'")
def prefix_scan(spark, d):
    return reads.prefix_scan(V.order_versions(spark, d), "o00000001")


@query(f"WITH {LIVE}, {CU} SELECT cu.key AS target, min(live.key) AS found FROM cu LEFT JOIN live ON live.key >= cu.key GROUP BY cu.key")
def seek_ge(spark, d):
    return reads.seek(V.event_versions(spark, d), customers(spark, d).select(F.col("key").alias("target")))


@query(f"WITH {LIVE} SELECT * FROM live WHERE key >= '{LOW}' ORDER BY key")
def ordered_scan(spark, d):
    return reads.ordered(V.event_versions(spark, d), LOW)


@query(f"WITH {LIVE} SELECT * FROM live ORDER BY key DESC")
def ordered_reverse_scan(spark, d):
    return reads.ordered(V.event_versions(spark, d), reverse=True)


@query(f"""WITH {FL}, {CU} SELECT key, level, number, seq, value FROM loc WHERE key IN (SELECT key FROM cu)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY level, CASE WHEN level = 0 THEN -number ELSE 0 END, seq DESC) = 1 AND rtype = 0""")
def get_by_level(spark, d):
    return reads.get_by_level(V.located_versions(spark, d), customers(spark, d))


@query(f"WITH {LIVE} SELECT min(key) AS first_key, max(key) AS last_key FROM live")
def seek_first_last(spark, d):
    return reads.ends(V.event_versions(spark, d))


@query(f"WITH {LIVE} SELECT key, lead(key) OVER (ORDER BY key) AS next_key FROM live")
def next_key(spark, d):
    return reads.neighbours(V.event_versions(spark, d)).select("key", "next_key")


@query(f"WITH {LIVE} SELECT key, lag(key) OVER (ORDER BY key) AS prev_key FROM live")
def prev_key(spark, d):
    return reads.neighbours(V.event_versions(spark, d)).select("key", "prev_key")


@query(f"WITH {EV}, {CU} SELECT key, key IN (SELECT key FROM ev) AS present FROM cu")
def contains(spark, d):
    return reads.contains(V.event_versions(spark, d), customers(spark, d))


@query(f"WITH {EV} SELECT key, seq, CAST(rtype AS INTEGER) AS rtype, value FROM ev ORDER BY key, seq DESC")
def dump_versions(spark, d):
    return reads.dump(V.event_versions(spark, d))


@query("SELECT max(event_id) + 1 AS last_seq FROM events")
def last_sequence(spark, d):
    return reads.last_sequence(V.event_versions(spark, d))


@query(f"WITH {EV} SELECT key, seq, CAST(rtype AS INTEGER) AS rtype, value FROM ev")
def batch_apply(spark, d):
    return batches.apply(V.batches(spark, d))


@query(f"WITH {EV} SELECT key, seq + 1000 AS seq, CAST(rtype AS INTEGER) AS rtype, value FROM ev")
def batch_append(spark, d):
    return batches.apply(batches.append(V.batches(spark, d), 3), 1000)


@query("SELECT event_id // 100 AS batch_id, CAST(count(*) AS INTEGER) AS n_ops FROM events GROUP BY 1")
def batch_count(spark, d):
    return batches.counts(V.batches(spark, d))


FAULTY = """ev AS (SELECT event_id // 100 AS batch_id, event_id % 1103 = 5 AS bad_type, event_id % 1511 = 7 AS no_key, event_id FROM events)"""


@query(f"""WITH {FAULTY}, b AS (SELECT batch_id, batch_id % 10 = 3 AS miscounted, bool_or(bad_type) AS bad_type, bool_or(no_key) AS no_key FROM ev GROUP BY batch_id)
SELECT batch_id, CASE WHEN miscounted THEN 'count' WHEN bad_type THEN 'type' ELSE 'key' END AS error FROM b WHERE miscounted OR bad_type OR no_key""")
def batch_errors(spark, d):
    return batches.errors(V.faulty_batches(spark, d))


@query("""SELECT 'p' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') AS key, l_orderkey * 8 + l_linenumber AS seq, CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS rtype,
  min(CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END) AS value FROM lineitem GROUP BY 1, 2, 3""")
def dedupe_exact(spark, d):
    return batches.distinct_versions(V.lineitem_versions(spark, d))


@query(f"WITH {EV} SELECT CAST(sum(strlen(key) + CASE WHEN value IS NULL THEN 0 ELSE 8 END + 16) AS BIGINT) AS usage FROM ev")
def mem_usage(spark, d):
    return batches.memory_usage(V.event_versions(spark, d))


@query(f"WITH {EV} SELECT key, seq, CAST(rtype AS INTEGER) AS rtype, value, CAST((seq - 1) % 4 AS INTEGER) AS run_id FROM ev ORDER BY key, seq DESC")
def merge_runs(spark, d):
    return merge.merge(V.runs(spark, d))


@query(f"WITH {EV} SELECT key, seq, CAST(rtype AS INTEGER) AS rtype, value, CAST((seq - 1) % 4 AS INTEGER) AS run_id FROM ev ORDER BY key DESC, seq")
def reverse_scan(spark, d):
    return merge.merge(V.runs(spark, d), reverse=True)


@query(f"WITH {LIVE} SELECT * FROM live")
def merge_latest(spark, d):
    return reads.live(merge.merge(V.runs(spark, d)))


@query(f"WITH {FL} SELECT key, seq, CAST(rtype AS INTEGER) AS rtype, value FROM loc WHERE level = 1 AND key >= '{LOW}' AND key < '{HIGH}'")
def two_level_scan(spark, d):
    return merge.two_level_scan(V.located_versions(spark, d), V.files(spark, d), 1, LOW, HIGH)


@query(f"WITH {FL} SELECT * FROM fl")
def file_ranges(spark, d):
    return V.files(spark, d)


@query(f"""WITH {FL}, {CU}, m AS (SELECT cu.key, level, min(largest) AS largest FROM cu JOIN fl ON largest >= cu.key GROUP BY cu.key, level)
SELECT m.key, m.level, min(number) AS number FROM m JOIN fl ON m.level = fl.level AND m.largest = fl.largest GROUP BY m.key, m.level""")
def find_table(spark, d):
    return prune.find_table(customers(spark, d), V.files(spark, d))


@query(f"""WITH {FL}, {CU}, {RANGES} SELECT l.level, rg.id, count(number) AS n_files FROM rg CROSS JOIN (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS level) AS l
LEFT JOIN fl ON fl.level = l.level AND smallest <= high AND largest >= low GROUP BY l.level, rg.id""")
def overlap_counts(spark, d):
    each = ranges(spark, d).withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    return prune.overlap_counts(each, V.files(spark, d))


@query(f"WITH {FL} SELECT * FROM fl WHERE level = 1 AND smallest <= '{HIGH}' AND largest >= '{LOW}'")
def overlap_inputs(spark, d):
    return prune.overlapping(V.files(spark, d), 1, LOW, HIGH)


@query(f"""WITH {FL}, g AS (SELECT *, CASE WHEN smallest > max(largest) OVER (PARTITION BY level ORDER BY smallest, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS gap FROM fl)
SELECT level, number, CAST(1 + sum(gap) OVER (PARTITION BY level ORDER BY smallest, number) AS BIGINT) AS island FROM g""")
def overlap_islands(spark, d):
    return prune.islands(V.files(spark, d))


@query(f"""WITH {FL}, g AS (SELECT *, CASE WHEN smallest > max(largest) OVER (ORDER BY smallest, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS gap FROM fl WHERE level = 0),
i AS (SELECT *, sum(gap) OVER (ORDER BY smallest, number) AS island FROM g)
SELECT level, number, smallest, largest, file_size FROM i WHERE island IN (SELECT island FROM i WHERE smallest <= '{HIGH}' AND largest >= '{LOW}')""")
def overlap_widened(spark, d):
    return prune.widened(V.files(spark, d), LOW, HIGH)


@query(f"WITH {EV} SELECT (seq - 1) * 100 // 2048 AS slot, count(DISTINCT key) AS n_keys FROM ev GROUP BY 1")
def filter_slots(spark, d):
    return prune.filter_slots(V.event_versions(spark, d).select(((F.col("seq") - 1) * 100).alias("offset"), "key"))


@query()
def bloom_bits(spark, d):
    return prune.bloom_bits(V.located_versions(spark, d), "number")


@query()
def bloom_probe(spark, d):
    files = V.files(spark, d).select("number")
    probes = V.located_versions(spark, d).select("number", "key").union(files.select("number", F.concat(F.lit("absent"), F.col("number"))))
    return prune.bloom_probe(probes, prune.bloom_bits(V.located_versions(spark, d), "number"), "number")


@query()
def crc(spark, d):
    return V.event_versions(spark, d).select("key").distinct().select("key", F.crc32(F.col("key").cast("binary")).alias("crc"))


@query(f"WITH {FL} SELECT level, count(*) AS n_files, CAST(sum(file_size) AS BIGINT) AS n_bytes FROM fl GROUP BY level")
def level_stats(spark, d):
    return compaction.level_stats(V.files(spark, d))


@query(f"""WITH {FL} SELECT level, CASE WHEN level = 0 THEN count(*) / 4.0e0 ELSE sum(file_size) / (10485760.0e0 * 10.0e0 ** greatest(level - 1, 0)) END AS score
FROM fl GROUP BY level ORDER BY score DESC, level LIMIT 1""")
def score(spark, d):
    return compaction.scores(V.files(spark, d))


@query(f"""WITH {FL}, c AS (SELECT * FROM fl WHERE level = 1 ORDER BY smallest, number LIMIT 1)
SELECT 0 AS side, number FROM c UNION ALL SELECT 1, fl.number FROM fl, c WHERE fl.level = 2 AND fl.smallest <= c.largest AND fl.largest >= c.smallest""")
def pick_compaction(spark, d):
    return compaction.pick(V.files(spark, d), 1)


@query(f"""WITH {FL}, {CU}, {RANGES}, n AS (SELECT rg.id, count(*) FILTER (level = 0) AS a, count(*) FILTER (level = 1) AS b, count(*) FILTER (level = 2) AS c
  FROM rg LEFT JOIN fl ON smallest <= high AND largest >= low GROUP BY rg.id) SELECT id, CASE WHEN a > 0 OR b > 0 THEN 0 WHEN c > 0 THEN 1 ELSE 2 END AS level FROM n""")
def pick_mem_level(spark, d):
    return compaction.level_for_flush(ranges(spark, d), V.files(spark, d))


@query(f"WITH {EV} SELECT key, seq, CAST(rtype AS INTEGER) AS rtype, value FROM ev")
def compact_retain(spark, d):
    return compaction.rewrite(V.event_versions(spark, d), 8)


@query(f"WITH {LIVE} SELECT key, seq, 0 AS rtype, value FROM live")
def compact_drop(spark, d):
    return compaction.rewrite(V.event_versions(spark, d), 8, drop=True)


@query(f"""WITH {EV}, s AS (SELECT key, sum(strlen(key) + CASE WHEN value IS NULL THEN 0 ELSE 8 END + 16) AS w FROM ev GROUP BY key),
f AS (SELECT key, CAST(coalesce(sum(w) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 65536 AS BIGINT) AS file FROM s)
SELECT key, seq, CAST(rtype AS INTEGER) AS rtype, value, file FROM ev JOIN f USING (key)""")
def compact_by_size(spark, d):
    return compaction.cut_by_size(V.event_versions(spark, d), 65536)


@query(f"""WITH {LIVE} SELECT key, seq, 0 AS rtype, value FROM live WHERE key BETWEEN '{LOW}' AND '{HIGH}'
UNION ALL SELECT key, seq, rtype, value FROM ev WHERE key NOT BETWEEN '{LOW}' AND '{HIGH}'""")
def compact_range(spark, d):
    return compaction.compact_range(V.event_versions(spark, d), LOW, HIGH)


@query(f"""WITH {FL} SELECT CAST(coalesce(max(n), 0) AS BIGINT) AS most_bytes FROM (SELECT f.number, sum(g.file_size) AS n FROM fl AS f JOIN fl AS g
  ON f.level >= 1 AND g.level = f.level + 1 AND g.smallest <= f.largest AND g.largest >= f.smallest GROUP BY f.number) AS x""")
def next_overlap_bytes(spark, d):
    return compaction.next_overlap_bytes(V.files(spark, d))


@query(f"WITH {ED} SELECT level, number FROM (SELECT *, row_number() OVER (PARTITION BY level, number ORDER BY edit_id DESC, phase DESC) AS k FROM ed) AS x WHERE k = 1 AND phase = 1")
def manifest_fold(spark, d):
    return manifest.fold(V.edits(spark, d))


@query(f"WITH {ED} SELECT max(edit_id) + 1 AS next_file, max(edit_id) FILTER (edit_id % 7 = 0) AS log_number FROM ed")
def manifest_scalars(spark, d):
    e = V.edits(spark, d).select("edit_id", (F.col("edit_id") + 1).alias("next_file"), F.when(F.col("edit_id") % 7 == 0, F.col("edit_id")).alias("log_number"))
    return manifest.scalars(e, ["next_file", "log_number"])


@query(f"""WITH {ED}, c AS (SELECT CAST(v AS INTEGER) AS version, v * 40 + 20 AS cut FROM (SELECT unnest([0, 1, 2, 3]) AS v) AS y)
SELECT version, number FROM (SELECT version, number, phase, row_number() OVER (PARTITION BY version, level, number ORDER BY edit_id DESC, phase DESC) AS k
  FROM ed JOIN c ON edit_id <= cut) AS x WHERE k = 1 AND phase = 1""")
def live_files(spark, d):
    return manifest.live_files(V.edits(spark, d), [20, 60, 100, 140])


@query(f"""WITH {FL}, {CU}, {RANGES} SELECT rg.id, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS n_bytes FROM rg
LEFT JOIN fl ON low < high AND smallest < high AND largest >= low GROUP BY rg.id""")
def approx_sizes(spark, d):
    r = ranges(spark, d)
    sizes = stats.approximate_sizes(r.where("low < high"), V.files(spark, d))
    return r.join(sizes, "id", "left").select("id", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"))


@query(f"WITH {FL}, {CU} SELECT c_custkey AS id, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS \"offset\" FROM cu LEFT JOIN fl ON largest < key GROUP BY c_custkey")
def approx_offset(spark, d):
    return stats.approximate_offsets(customers(spark, d).select(F.col("c_custkey").alias("id"), "key"), V.files(spark, d))


@query(f"WITH {FL} SELECT level, number || ':' || file_size || '[' || smallest || ' .. ' || largest || ']' AS description FROM fl")
def table_descriptions(spark, d):
    return stats.describe_tables(V.files(spark, d))


@query(f"""WITH {LIVE}, n AS (SELECT key, lead(key) OVER (ORDER BY key) AS next_key FROM live)
SELECT key, next_key, CAST(len(list_filter(range(1, length(key) + 1), lambda i: left(key, i) = left(next_key, i))) AS INTEGER) AS shared FROM n WHERE next_key IS NOT NULL""")
def common_prefix(spark, d):
    pairs = reads.neighbours(V.event_versions(spark, d)).where("next_key is not null")
    return pairs.select("key", "next_key", K.common_prefix(F.col("key"), F.col("next_key")).alias("shared"))


@query(f"""WITH {LIVE}, n AS (SELECT key, lead(key) OVER (ORDER BY key) AS next_key FROM live),
p AS (SELECT key, next_key, left(next_key, 1 + len(list_filter(range(1, length(key) + 1), lambda i: left(key, i) = left(next_key, i)))) AS k FROM n WHERE next_key IS NOT NULL)
SELECT key, next_key, CASE WHEN key <= k AND k < next_key THEN k ELSE key END AS short_key FROM p""")
def separator(spark, d):
    pairs = reads.neighbours(V.event_versions(spark, d)).where("next_key is not null")
    return pairs.select("key", "next_key", K.separator(F.col("key"), F.col("next_key")).alias("short_key"))


_NAMES = "SELECT number, 'db/' || lpad(CAST(number AS VARCHAR), 6, '0') || '.log' AS log, 'db/' || lpad(CAST(number AS VARCHAR), 6, '0') || '.ldb' AS tab, 'db/MANIFEST-' || lpad(CAST(number AS VARCHAR), 6, '0') AS descriptor, 'db/CURRENT' AS cur FROM fl"


@query(f"WITH {FL} {_NAMES}")
def file_names(spark, d):
    name = lambda kind: K.file_name(kind, F.lit("db"), F.col("number"))
    return V.files(spark, d).select("number", name("log").alias("log"), name("table").alias("tab"), name("descriptor").alias("descriptor"), name("current").alias("cur"))


@query(f"WITH {FL}, n AS ({_NAMES}) SELECT tab AS name, number, 'table' AS kind FROM n UNION ALL SELECT descriptor, number, 'descriptor' FROM n UNION ALL SELECT 'db/LOCK', 0, 'lock' FROM n")
def parse_file_names(spark, d):
    f = V.files(spark, d)
    kinds = [K.file_name(k, F.lit("db"), F.col("number")).alias("name") for k in ("table", "descriptor", "lock")]
    names = f.select(kinds[0]).union(f.select(kinds[1])).union(f.select(kinds[2]))
    number, kind = K.parsed_name(F.col("name"))
    return names.select("name", number.alias("number"), kind.alias("kind"))


@query("SELECT CAST(l AS INTEGER) AS level, 10485760.0e0 * 10.0e0 ** greatest(l - 1, 0) AS budget FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS l) AS x")
def level_budget(spark, d):
    return spark.range(7).select(F.col("id").cast("int").alias("level"), K.level_budget(F.col("id")).alias("budget"))
