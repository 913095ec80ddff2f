"""Small cases of the version operators: markers, ties, ranges, filters, storage and streams."""

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.functions import keys as K
from tidemark.functions.order import heavy_keys, next_and_previous, successor, weight_between
from tidemark.operators import batches, compaction, manifest, merge, prune, reads
from tidemark.plans import catalog
from tidemark.sources import versions as store
from tidemark.streaming import versions as streams

V = "key string, seq long, rtype int, value double"
ROWS = [("a", 1, 0, 1.0), ("b", 2, 0, 2.0), ("a", 3, 1, None), ("c", 4, 0, None), ("b", 5, 0, 5.0), ("a", 6, 0, 6.0), ("d", 7, 1, None)]


@pytest.fixture(scope="module")
def versions(spark):
    return spark.createDataFrame(ROWS, V)


def _replay(rows, snapshot=10**9):
    state = {}
    for k, s, t, v in sorted(rows, key=lambda r: r[1]):
        if s <= snapshot:
            state[k] = (s, t, v)
    return {(k, s, v) for k, (s, t, v) in state.items() if t == 0}


@pytest.mark.parametrize("snapshot", [0, 1, 2, 3, 5, 7])
def test_snapshots_equal_a_replay(versions, snapshot):
    assert {tuple(r) for r in reads.live_at(versions, snapshot).collect()} == _replay(ROWS, snapshot)


def test_large_sequence_numbers(spark):
    top = 2**55
    rows = [("a", top + 1, 0, 1.0), ("a", top + 3, 0, 3.0), ("a", top + 2, 1, None), ("b", top + 5, 1, None), ("b", top + 4, 0, 4.0), ("c", 2**56 - 1, 0, 5.0), ("d", 2**61 - 1, 0, 6.0)]
    got = {tuple(r) for r in reads.newest(spark.createDataFrame(rows, V)).collect()}
    assert got == {("a", top + 3, 0, 3.0), ("b", top + 5, 1, None), ("c", 2**56 - 1, 0, 5.0), ("d", 2**61 - 1, 0, 6.0)}


def test_lookup_from_level_to_level(spark):
    rows = [("a", 9, 0, 9.0, 1, 1), ("a", 5, 0, 5.0, 0, 7), ("a", 7, 0, 7.0, 0, 6), ("b", 3, 1, None, 0, 8), ("b", 2, 0, 2.0, 1, 1), ("c", 1, 0, 1.0, 2, 2), ("c", 4, 0, 4.0, 2, 2)]
    located = spark.createDataFrame(rows, V + ", level int, number long")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("x",), ("a",)], "key string")
    assert {tuple(r) for r in reads.get_by_level(located, keys).collect()} == {("a", 0, 7, 5, 5.0), ("c", 2, 2, 4, 4.0)}
    assert {tuple(r) for r in reads.get_by_level(located, keys, 2).collect()} == {("b", 1, 1, 2, 2.0), ("c", 2, 2, 1, 1.0)}


def test_ordered_scans(versions):
    assert [r.key for r in reads.ordered(versions).collect()] == ["a", "b", "c"]
    assert [r.key for r in reads.ordered(versions, "b", reverse=True).collect()] == ["c", "b"]


def test_malformed_batches_are_errors(spark):
    schema = "batch_id long, ops array<struct<rtype int, key string, value string>>, n_ops int"
    rows = [(0, [(0, "a", "x")], 1), (1, [(2, "a", "x")], 1), (2, [(0, None, "x")], 1), (3, [(1, "a", None)], 2), (4, None, 0), (5, [], 0), (6, [(None, "a", "x")], 1)]
    df = spark.createDataFrame(rows, schema)
    assert {tuple(r) for r in batches.errors(df).collect()} == {(1, "type"), (2, "key"), (3, "count"), (4, "count"), (6, "type")}
    assert [tuple(r) for r in batches.apply(df.where("batch_id in (0, 4, 5)")).collect()] == [("a", 1, 0, "x")]
    for bad in (1, 2, 6):
        with pytest.raises(Exception, match=f"malformed batch {bad}"):
            batches.apply(df.where(F.col("batch_id").isin(0, bad))).collect()


def test_range_is_widened_until_nothing_is_added(spark):
    rows = [(0, 1, "a", "c"), (0, 2, "c", "e"), (0, 3, "e", "g"), (0, 4, "h", "k"), (0, 5, "x", "z"), (1, 6, "a", "z")]
    files = spark.createDataFrame([(*r, 10) for r in rows], "level int, number long, smallest string, largest string, file_size long")
    numbers = lambda low, high: sorted(r.number for r in prune.widened(files, low, high).collect())
    assert numbers("a", "b") == [1, 2, 3] and numbers("f", "h") == [1, 2, 3, 4] and numbers("l", "m") == [] and numbers(None, None) == [1, 2, 3, 4, 5]


def test_files_are_cut_by_size(spark):
    rows = [(f"k{i:03d}", j, 0, 1.0) for i in range(50) for j in range(1 + i % 3)]
    got = compaction.cut_by_size(spark.createDataFrame(rows, V), 280, parts=7).collect()
    below = lambda k: sum(28 for r in rows if r[0] < k)
    assert {(r.key, r.file) for r in got} == {(r[0], below(r[0]) // 280) for r in rows} and len(got) == len(rows)


def test_put_of_nothing_is_not_a_deletion(versions):
    assert [tuple(r) for r in reads.get(versions, "c").collect()] == [("c", 4, None)]
    assert reads.get(versions, "d").count() == 0
    assert {tuple(r) for r in reads.multi_get(versions, versions.select("key").union(versions.sparkSession.createDataFrame([("x",)], "key string"))).select("key", "found").collect()} == {("a", True), ("b", True), ("c", True), ("d", False), ("x", False)}


def test_as_of(spark, versions):
    probes = spark.createDataFrame([(k, s) for k in "abcdx" for s in range(9)], "key string, snapshot long")
    got = {(r.key, r.snapshot, r.seq, r.value) for r in reads.get_as_of(versions, probes).collect()}
    assert got == {(k, s, q, v) for s in range(9) for k, q, v in _replay(ROWS, s)}


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_as_of_with_a_hot_key(spark, parts):
    rng = random.Random(3)
    seqs = rng.sample(range(1000), 300)
    rows = [("hot'\\" if i % 3 else f"k{i % 40}", s, int(rng.random() < 0.3), float(s)) for i, s in enumerate(seqs)]
    rows += [("a", 2000, 0, 1.0), (None, 1, 0, 1.0), ("tie", 5, 0, 5.0), ("tie", 5, 1, None)]
    asked = [(k, s) for k in ("hot'\\", "k3", "a", "tie", "x") for s in (-1, 0, 5, *range(7, 1100, 7), 10**15)] + [("hot'\\", 999)] * 3 + [("hot'\\", None)]
    versions, probes = spark.createDataFrame(rows, V), spark.createDataFrame(asked, "key string, snapshot long")
    heavy = heavy_keys(versions, "key", "seq", parts)
    assert sum(len(cuts) + 1 for cuts in heavy.values()) < 2 * parts + 1 and (parts == 1 or "hot'\\" in heavy)

    def want(key, snapshot):
        before = [r for r in rows if r[0] == key and snapshot is not None and r[1] <= snapshot]
        last = max(before, key=lambda r: r[1:3], default=None)
        return [(key, snapshot, last[1], last[3])] if last and last[2] == 0 else []

    got = sorted(tuple(r) for r in reads.get_as_of(versions, probes, parts).collect())
    assert got == sorted(x for p in asked for x in want(*p))
    assert reads.get_as_of(versions.limit(0), probes, parts).count() == reads.get_as_of(versions, probes.limit(0), parts).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 3, 64])
def test_order_lookups(spark, parts):
    names = ["", "a", "a'b\\", "ab", "b", "ba", "c\u00e9", "c\U0001f642"]
    keys = spark.createDataFrame([(k,) for k in names], "key string")
    assert {r.key: (r.prev_key, r.next_key) for r in next_and_previous(keys, parts).collect()} == {k: (names[i - 1] if i else None, names[i + 1] if i + 1 < len(names) else None) for i, k in enumerate(names)}
    asked = ["", "aa", "a'b", "abd", "bb", "d"]
    got = successor(spark.createDataFrame([(t,) for t in asked], "target string"), keys, parts).collect()
    assert {r.target: r.found for r in got} == {t: min((k for k in names if k >= t), default=None) for t in asked}
    assert next_and_previous(keys.limit(0), parts).count() == 0


@pytest.mark.parametrize("closed", [True, False])
def test_weights_of_overlaps(spark, closed):
    spans = [("a", "c", 1), ("b", "b", 2), ("c", "f", 4), ("ca", "d", 8), ("g", "h", 16)]
    df = spark.createDataFrame(spans, "first string, last string, w long")
    asked = [(1, "a", "b"), (2, "b", "c"), (3, "d", "g"), (4, "i", "j"), (5, None, "b"), (6, "f", None), (7, None, None)]
    rows = spark.createDataFrame([(*r, closed) for r in asked], "id long, low string, high string, closed boolean")
    got = weight_between(rows, df, 3)
    over = lambda a, b, lo, hi: (a is None or hi >= a) and (b is None or (lo <= b if closed else lo < b))
    assert {r.id: r.w for r in got.collect()} == {i: sum(w for lo, hi, w in spans if over(a, b, lo, hi)) for i, a, b in asked}


def test_batches(spark):
    put, delete = (lambda k, v: (0, k, v)), (lambda k: (1, k, None))
    schema = "batch_id long, ops array<struct<rtype int, key string, value string>>"
    three = spark.createDataFrame([(0, [put("foo", "bar"), delete("box"), put("baz", "boo")])], schema)
    got = batches.apply(three, 99).orderBy("key").collect()
    assert [(r.key, r.seq, r.rtype) for r in got] == [("baz", 102, 0), ("box", 101, 1), ("foo", 100, 0)]
    more = spark.createDataFrame([(0, []), (1, [put("a", "va")]), (2, []), (3, [put("b", "vb"), delete("foo")])], schema)
    assert [(r.seq, r.key) for r in batches.apply(batches.append(more, 4), 199).orderBy("seq").collect()] == [(200, "a"), (201, "b"), (202, "foo")]
    assert batches.apply(more.limit(0)).count() == 0


def test_merge_keeps_all_and_reverses(spark, versions):
    runs = [versions.where("seq % 2 = 0"), versions.where("seq % 2 = 1"), versions.where("seq = 1")]
    forward = [tuple(r) for r in merge.merge(runs).collect()]
    assert forward == list(reversed([tuple(r) for r in merge.merge(runs, reverse=True).collect()]))
    assert len(forward) == 8 and forward[0][1] == 6
    with pytest.raises(ValueError):
        merge.merge([])


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(2000).select((F.col("id") % 4).alias("slot"), F.concat(F.lit("key"), "id").alias("key"))
    absent = spark.range(2000).select((F.col("id") % 5).alias("slot"), F.concat(F.lit("not"), "id").alias("key"))
    bits = prune.bloom_bits(keys, "slot")
    assert prune.bloom_probe(keys, bits, "slot").where("not may_match").count() == 0
    assert prune.bloom_probe(absent, bits, "slot").where("may_match").count() < 60
    one = {r.bit for r in prune.bloom_bits(keys.where("key = 'key8'"), "slot").collect()}
    h = zlib.crc32(b"key8")
    d = (h >> 17) | (h << 15) & 0xFFFFFFFF
    assert one == {(h + j * d & 0xFFFFFFFF) % 64 for j in range(6)}


def test_pick_and_range_compaction(spark, versions):
    files = spark.createDataFrame([(0, 1, "a", "c", 10), (0, 2, "b", "f", 10), (0, 3, "x", "z", 10), (1, 4, "e", "g", 10), (1, 5, "h", "i", 10)], "level int, number long, smallest string, largest string, file_size long")
    assert {tuple(r) for r in compaction.pick(files, 0).collect()} == {(0, 1), (0, 2), (1, 4)}
    got = compaction.compact_range(versions, "a", "b").collect()
    assert {tuple(r)[:3] for r in got} == {("a", 6, 0), ("b", 5, 0), ("c", 4, 0), ("d", 7, 1)}
    assert compaction.compact_range(versions, None, None).count() == 3


def test_edits_fold_like_a_set(spark):
    rows = [(1, 1, 0, 7), (2, 0, 0, 7), (2, 1, 1, 7), (3, 1, 0, 8), (4, 0, 0, 8), (4, 1, 0, 8), (5, 0, 1, 9)]
    state = defaultdict(bool)
    for _, phase, level, number in sorted(rows):
        state[level, number] = phase == 1
    df = spark.createDataFrame(rows, "edit_id long, phase int, level int, number long")
    assert {tuple(r) for r in manifest.fold(df).collect()} == {k for k, v in state.items() if v}


def test_keys_and_names(spark):
    pairs = [("", "a"), ("abc", "abd"), ("ab", "abc"), ("x", "y"), ("same", "same")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select(K.common_prefix(F.col("a"), F.col("b")), K.separator(F.col("a"), F.col("b")), "a", "b").collect()
    assert [r[0] for r in got] == [0, 2, 2, 0, 4]
    assert all(r.a <= r[1] < r.b for r in got if r.a < r.b)
    names = spark.createDataFrame([("db/000007.log",), ("db/MANIFEST-000012",), ("CURRENT",), ("x/LOG.old",), ("db/what",), ("db/000003.dbtmp",)], "name string")
    number, kind = K.parsed_name(F.col("name"))
    assert [tuple(r) for r in names.select(number, kind).collect()] == [(7, "log"), (12, "descriptor"), (0, "current"), (0, "old_info"), (-1, None), (3, "temp")]
    assert [K.bloom_hashes(b) for b in (1, 10, 16, 100)] == [1, 6, 11, 30]


def test_store_and_stream(spark, tmp_path):
    path = str(tmp_path / "v")
    store.create(spark, path)
    schema = "batch_id long, ops array<struct<rtype int, key string, value double>>"
    assert store.write(spark, path, spark.createDataFrame([(0, [(0, "a", 1.0), (0, "b", 2.0)])], schema)) == 2
    assert store.write(spark, path, spark.createDataFrame([(0, [(1, "a", None)]), (1, [(0, "c", 3.0)])], schema)) == 4
    live = [("b", 2, 2.0), ("c", 4, 3.0)]
    assert sorted(tuple(r) for r in reads.live(store.read(spark, path)).collect()) == live
    store.compact(spark, path, str(tmp_path / "w"), 2, drop=True)
    assert sorted(tuple(r) for r in reads.live(store.read(spark, str(tmp_path / "w"))).collect()) == live
    met = [tuple(r) for r in store.files(spark, path).select("level", "number", "smallest", "largest", "n_versions").orderBy("number").collect()]
    assert sum(r[4] for r in met) == 4 and [r[1] for r in met] == list(range(1, len(met) + 1)) and {r[0] for r in met} == {0}
    assert prune.overlapping(store.files(spark, path), 0, "c", None).count() >= 1
    assert store.files(spark, path).where("file_size <= 0 or name is null").count() == 0
    newest = reads.live(streams.tail(spark, path, files_per_batch=1))
    run = newest.writeStream.format("memory").queryName("live_view").outputMode("complete").trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("live_view").collect()) == live
    run = streams.append(streams.tail(spark, path), str(tmp_path / "copy"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    assert store.read(spark, str(tmp_path / "copy")).count() == 4
    run = streams.append(streams.tail(spark, path, since=2), str(tmp_path / "later"), str(tmp_path / "cp2")).trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    assert sorted(r.seq for r in store.read(spark, str(tmp_path / "later")).collect()) == [3, 4]


def test_no_pass_of_rows_through_one_task(spark, sf):
    """Only summaries, which have a row for each range, are in one partition, and a seek is one window over the ranges."""
    for name in ("seek_ge", "next_key", "find_table", "overlap_counts", "approx_sizes", "batch_apply"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        for i, line in enumerate(lines):
            if "SinglePartition" in line:
                assert any("Aggregate(key" in x and "__part" in x for x in lines[i + 1 : i + 3]), (name, lines[i : i + 3])


def test_rows_only_queries(spark, sf):
    probe = catalog.QUERIES["bloom_probe"](spark, sf)
    assert probe.where("not may_match and key like 'user%'").count() == 0
    assert all(r.crc == zlib.crc32(r.key.encode()) for r in catalog.QUERIES["crc"](spark, sf).collect())


def test_range_reaches_the_scan(spark, sf):
    plan = reads.scan(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderstatus").alias("key"), F.col("o_orderkey").alias("seq"), F.lit(0).alias("rtype"), F.col("o_totalprice").alias("value")), "F", "P")
    text = plan._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderstatus,F)" in text and "LessThan(o_orderstatus,P)" in text
