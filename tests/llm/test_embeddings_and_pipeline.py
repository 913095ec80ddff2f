"""Embedding near-duplicates by brute force, and the pipeline stage by stage."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import embedding_dedup, queries
from tidemark.llm.text_stats import counts_of


def _brute(rows, threshold=0.9):
    fine = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    for dim in {len(v) for _, v in fine}:
        ids = [i for i, v in fine if len(v) == dim]
        x = np.array([v for _, v in fine if len(v) == dim])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= threshold
        for a, b in zip(*np.nonzero(near), strict=True):
            if a != b:
                links[ids[a]] += 1
        for _ in range(len(ids)):
            before = dict(root)
            for a, b in zip(*np.nonzero(near), strict=True):
                root[ids[a]] = root[ids[b]] = min(root[ids[a]], root[ids[b]])
            if before == root:
                break
    return {i: (links[i], root[i], root[i] == i) for i, _ in rows}


def test_whole_table(spark, sf):
    rows = duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op7_embedding_dedup(spark, sf).collect()}
    assert got == _brute(rows)


@pytest.mark.parametrize("tile_rows", [7, 64])
def test_tiles_and_odd_vectors(spark, tile_rows):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 16))
    near = [(base[i % 12] + rng.normal(size=16) * 0.25).tolist() for i in range(120)]
    rows = list(enumerate(near)) + [(200, None), (201, []), (202, [0.0] * 16), (203, [float("nan")] * 16), (204, [None, *[1.0] * 15]), (205, near[0]), (206, near[0]), (207, [1.0, 2.0]), (208, [2.0, 4.0]), (209, [float("inf")] * 16), (210, [3.0 * x for x in near[1]])]
    df = spark.createDataFrame([(i, v, 1, True) for i, v in rows], "vec_id long, embedding array<double>, label int, kept boolean")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, tile_rows=tile_rows, sample_rows=40).collect()}
    assert got == _brute(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0 and embedding_dedup.near_duplicates(df.where("vec_id between 200 and 204")).where("n_links = 0 and kept").count() == 5


def test_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [-1.0, 0.0]), (4, [-1.0, 0.01]), (4, [0.02, 1.0]), (5, [0.7, -0.7]), (None, [1.0, 0.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 1, False), (4, 1, 1, False), (5, 0, 5, True), (None, 0, None, True)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    alone = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(alone, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_tiles_out_of_reach_are_left_out():
    rng = np.random.default_rng(2)
    centres = np.eye(8)[:4] * 3
    x = np.concatenate([c + rng.normal(size=(200, 8)) * 0.1 for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cuts = embedding_dedup.cuts_of(x, 2)
    tiles = cuts.tiles(x)
    low, high = (np.array([f(x[tiles == t], 0) for t in range(4)]) for f in (np.min, np.max))
    near = embedding_dedup.within_reach(low, high, 0.45)
    assert sum(map(len, near)) < 10
    for i, j in zip(*np.nonzero(x @ x.T >= 0.9), strict=True):
        assert max(tiles[i], tiles[j]) in near[min(tiles[i], tiles[j])]


def test_pipeline(spark, sf, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "order_minhash", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(path := str(tmp_path / str(len(ids))))
        docs = spark.read.parquet(path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert ids[3] <= ids[2] <= ids[1] <= ids[0] and len(ids[3]) > len(ids[0]) / 4
    judged = queries.op3_quality_rules(spark, sf).collect()
    assert ids[1] == {r.doc_id for r in judged if r.kept}
    packed = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in packed} == ids[3]


def test_stages_take_empty_tables_and_more_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("lang", "kept").withColumnRenamed("source", "n_words")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).count() == 0
    odd = docs.withColumnRenamed("kept", "counts").withColumnRenamed("n_words", "own").withColumn("__row", F.lit("keep me"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, sf)
        assert got.columns == odd.columns and got.where("`__row` <> 'keep me' or own is null").count() == 0 < got.count()
    assert corpus_pipeline.pack(spark, odd.limit(0), sf).count() == 0


def test_near_dedup_tells_texts_with_one_id_apart(spark, sf):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "x"), (1, b, "x"), (2, a + " end", "x"), (3, b, "x"), (4, "", "x"), (5, None, "x"), (1, a, "y"), (None, b, "z"), (None, "some text of its own here", "z"), (4, "", "x")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, own string"), sf).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, a), (1, b), (4, ""), (5, None), (None, "some text of its own here")], key=str)


def test_counts():
    assert counts_of(None) == counts_of("")
