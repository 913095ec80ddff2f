"""Near-duplicates against brute force over all pairs."""

import random
from itertools import combinations
from math import comb
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import order_minhash
from tidemark.llm.common import Scratch, shared_dir
from tidemark.llm.components import connected_components, merge_classes
from tidemark.llm.order_minhash import SHINGLE, aligned, links_of_tile, near_duplicates, shingles, single_below, sketch

WORDS = [f"w{i}" for i in range(4000)]


def _classes(texts: dict[int, str | None], threshold: float = 0.8) -> dict[int, int]:
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    words = {i: (t or "").encode().split() for i, t in texts.items()}
    labelled = {i: shingles(w)[1] for i, w in words.items() if len(w) >= SHINGLE}
    for i, j in combinations(sorted(texts), 2):
        same = words[i] == words[j] and words[i]
        if same or (i in labelled and j in labelled and aligned(labelled[i], labelled[j], threshold)):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in texts}


def test_whole_table(spark, sf):
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    got = near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == _classes(dict(rows))
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_hot_bucket_and_chain(spark):
    base = WORDS[:200]
    texts = {i: " ".join(base[:-1] + [f"end{i}"]) for i in range(60)}
    texts |= {100 + i: " ".join(WORDS[1000 + 12 * i : 1000 + 12 * i + 200]) for i in range(12)}  # each like the next only
    texts |= {300: None, 301: "", 302: "few words", 303: "few words", 304: " \n\t", 305: "other words"}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, class_id string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == _classes(texts)


def _near_the_threshold(n: int, seed: int) -> dict[int, str]:
    """Texts with 3 to 6 words of one base replaced, most pairs of which are a little more or less alike than asked."""
    rng, texts = random.Random(seed), {}
    for i in range(n):
        words = WORDS[:300]
        for k in range(rng.randint(3, 6)):
            words[rng.randrange(300)] = f"r{i}x{k}"
        texts[i] = " ".join(words)
    return texts


@pytest.mark.parametrize("block", [1 << 19, 6000])
def test_group_near_the_threshold_loses_no_link(spark, block):
    """All in one block, and in many blocks with buckets split by a second sketch."""
    texts = _near_the_threshold(160, 5)
    passage = " ".join(WORDS[1000:1060])
    texts |= {1000 + i: " ".join([*(f"p{i}x{k}" for k in range(15)), passage, *(f"q{i // 2}x{k}" for k in range(10))]) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df, block=block).collect()} == _classes(texts)


def test_links_of_a_tile_equal_all_pairs():
    texts = _near_the_threshold(60, 7)
    shingled = [shingles(t.encode().split())[1] for t in texts.values()]
    ids = np.array(list(texts))
    like = {(i, j) for i, j in combinations(range(60), 2) if aligned(shingled[i], shingled[j], 0.8)}
    rng = np.random.default_rng(3)
    for sides in (None, rng.integers(0, 2, 60)):
        order = rng.permutation(60)
        found = links_of_tile(None if sides is None else sides[order], ids[order], [shingled[i] for i in order], 0.8)
        pairs = {tuple(sorted((int(order[a]), int(order[b])))) for a, b in found}
        asked = {(i, j) for i, j in like if sides is None or sides[i] != sides[j]}
        assert pairs <= asked and _components(pairs) == _components(asked) and len(pairs) < 60


def _components(pairs) -> dict[int, int]:
    root = {x: x for p in pairs for x in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_two_sketches_are_asked_for_only_where_pairs_share_them():
    n = single_below(0.8)
    assert 5 <= n < 100
    for short, long_, both in ((n, n, None), (3 * n, 3 * n, None)):
        both = next(a for a in range(short + 1) if a >= 0.8 * (short + long_ - a) - 1e-9)
        p = comb(both, 3) / comb(short + long_ - both, 3)
        assert (1 - p) ** 24 + 24 * p * (1 - p) ** 23 <= 1 / 50_000


def test_short_texts_that_share_few_sketches(spark):
    """Of texts of 8 and 9 words with the same start, those of which only 1 or 2 sketches are equal."""
    texts = {}
    for k in range(30_000):
        words = [f"s{k}x{i}" for i in range(9)]
        keys = [sketch(*shingles([w.encode() for w in words[:n]])) for n in (8, 9)]
        if 0 < sum(x == y for x, y in zip(*keys, strict=True)) < 3:
            texts |= {2 * k: " ".join(words[:8]), 2 * k + 1: " ".join(words)}
        if len(texts) == 6:
            break
    assert len(texts) == 6
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == _classes(texts) == {i: i - i % 2 for i in texts}


def test_repeats_nulls_and_empty(spark):
    a, b = " ".join(WORDS[:30]), " ".join(WORDS[100:130])
    df = spark.createDataFrame([(1, a), (1, a), (2, a), (3, b), (4, b), (2, b), (None, a), (5, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in near_duplicates(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 1, False), (5, 5, True)]
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 9), (9, 5), (7, 8), (8, 3), (3, 2)]])
def test_components(spark, pairs):
    root = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {r.id: r.component for r in connected_components(df, Scratch(spark, "test")).collect()} == root


def test_merge_classes(spark):
    classes = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5), (8, 8), (9, 8)], "id long, component long")
    links = spark.createDataFrame([(5, 1), (7, 10), (8, 8)], "a long, b long")
    assert {r.id: r.component for r in merge_classes(classes, links, Scratch(spark, "test")).collect()} == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8, 7: 7, 10: 7}


def test_intermediate_tables_are_removed(spark):
    before = set(Path(shared_dir(spark)).glob("order-minhash-*"))
    assert near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).count() == 2
    assert len(set(Path(shared_dir(spark)).glob("order-minhash-*")) - before) == 1


def test_output_columns(spark, sf):
    assert near_duplicates(spark.read.parquet(f"{sf}/documents.parquet").withColumn("kept", F.lit(1)).limit(3)).columns == ["doc_id", "class_id", "kept"]


def test_pairs_of_a_hot_bucket_that_share_no_second_sketch(spark):
    """Two long texts of which a single sketch is equal, in a bucket whose centre is like neither of them."""
    rng, texts = random.Random(11), {}
    for k in range(400):
        a = [f"p{k}x{i}" for i in range(1720)]
        b = list(a)
        for at in rng.sample(range(1720), 85):
            b[at] = f"r{k}x{at}"
        (plain, la), (_, lb) = shingles([w.encode() for w in a]), shingles([w.encode() for w in b])
        if not aligned(la, lb, 0.6):
            continue
        same = [i for i, (x, y) in enumerate(zip(sketch(plain, la), sketch(plain, lb), strict=True)) if x == y]
        if len(same) != 1:
            continue
        h = la * order_minhash._MUL[same[0]] + order_minhash._ADD[same[0]]
        h ^= h >> np.uint64(31)
        first = sorted(np.argsort(h * order_minhash._C1)[:3].tolist())
        hubs = [[w for at in first for w in a[at : at + 5]] + [f"h{k}x{j}"] for j in range(6)]  # short texts with the sketch's shingles
        keys = [sketch(*shingles([w.encode() for w in hub]))[same[0]] for hub in hubs]
        if min(np.diff(first)) >= 5 and set(keys) == {sketch(plain, la)[same[0]]}:
            texts = {j: " ".join(hub) for j, hub in enumerate(hubs)} | {10: " ".join(a), 11: " ".join(b)}
            break
    assert len(texts) == 8
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(df, threshold=0.6, block=2000).collect()}
    assert got == _classes(texts, 0.6) and got[11] == 10


def test_a_repeated_id_with_a_short_text(spark):
    a = " ".join(WORDS[:60])
    df = spark.createDataFrame([(1, a), (1, "few words"), (2, a + " x"), (2, "two more"), (3, "few words"), (4, "four")], "doc_id long, text string")
    got = {(r.doc_id, r.class_id) for r in near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}
