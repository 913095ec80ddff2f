"""Classifier, rules, encoding, token counts and packing against brute force and the libraries."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe_automaton, packing, quality_classifier, quality_rules, queries, token_counts
from tidemark.llm.text_stats import FEATURES, counts_of, features, text_stats

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t", "a", "Ünïcödé  ΣΑΣ naïve x", "it's we'll 12345 ...!!  \n\n\n end ", "漢字 かな 🙂🙂 é", "<|endoftext|> x <|startoftext|>", "tab\tand\r\nline", "x" * 3000, "word " * 5000, "a\x1cb\x1fc"]
SCHEMA = "doc_id long, text string, ids int, score string, length string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 0, "s", "l") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[5], (None, "no id", 0, "s", "l")], SCHEMA)


@pytest.fixture(scope="module")
def texts(sf):
    return dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


def _library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_encode_and_decode_as_the_library(spark, sf, texts, odd):
    lib = _library(WORD)

    def want(text):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        return ids, lib.decode(ids, skip_special_tokens=False)

    for r in bpe_automaton.encode_decode(odd, WORD).collect():
        ids, text = want("no id" if r.doc_id is None else ODD[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == text
    got = {r.doc_id: r for r in queries.op5_bpe_automaton(spark, sf).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        ids, decoded = want(text)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe_automaton.encode_decode(odd.limit(0), WORD).count() == 0


def _greedy(word, first, following):
    n, at = 0, 0
    while at < len(word):
        pieces = following if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


def test_token_counts_as_greedy_pieces(spark, sf, texts, odd):
    first, following = map(set, token_counts.vocabulary(BYTE))

    def want(text):
        words = [w for p in (text or "").split() for w in token_counts.words_of(p)]
        found = [_greedy(w, first, following) for w in words]
        return len(words), sum(max(x, 1) for x in found), sum(x < 0 for x in found)

    few = {i: t for i, t in texts.items() if i % 4 == 0}
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in queries.op9_token_counts(spark, sf).collect()}
    assert len(got) == len(texts) and all(got[i] == want(t) for i, t in few.items())
    for r in token_counts.token_counts(odd, BYTE).collect():
        assert (r.n_words, r.n_tokens, r.n_unknown) == want("no id" if r.doc_id is None else ODD[r.doc_id])


@pytest.mark.parametrize("mark", ["-", "\u2e3b"])
def test_token_counts_of_a_text_of_rulers(spark, mark):
    first, following = map(set, token_counts.vocabulary(BYTE))
    unknown = _greedy(mark, first, following) < 0
    df = spark.createDataFrame([(1, " ".join([mark * 30] * 100_000)), (2, " ".join([mark * 1000] * 2500))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in token_counts.token_counts(df, BYTE).collect()}
    assert got == {1: (3_000_000, 3_000_000, 3_000_000 * unknown), 2: (2_500_000, 2_500_000, 2_500_000 * unknown)}


@pytest.mark.parametrize("seed", range(3))
def test_automaton_on_random_vocabularies(seed):
    rng = np.random.default_rng(seed)
    random = lambda n: {"".join(rng.choice(list("abc"), rng.integers(1, 5))) for _ in range(n)}
    first, following = random(12) | {"a"}, random(12) | {"b", "c"}
    counter = token_counts.CountAutomaton(sorted(first), sorted(following))
    for _ in range(500):
        word = "".join(rng.choice(list("abc"), rng.integers(1, 12)))
        assert counter.count(word) == _greedy(word, first, following)


def _check_packing(rows, texts, lib, capacity=2048):
    pieces, seen = {}, Counter()
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in texts.items():
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces.pop(i), key=lambda r: r.piece)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == len(ids)
        assert all(r.length == capacity for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert not pieces
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen[r.length] += 1
    for places in by.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= capacity
    gaps, opened = [], 0  # best-fit decreasing, one piece at a time
    for n in sorted(seen.elements(), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            opened += 1
            fit = capacity
        else:
            gaps.remove(fit)
        gaps.append(fit - n)
    assert len(by) == opened


def test_all_code_points_are_encoded_as_the_library_does():
    """Between letters, in blocks of white space apart, and in normal forms of other letters."""
    lib, enc = _library(WORD), bpe_automaton.encoder(WORD)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or 0xA000 <= c < 0xAC00 or 0xF900 <= c < 0x13000 or 0x16000 <= c < 0x17000 or c % 61 == 0)]
    for at in range(0, len(points), 256):
        texts = [f"a{chr(c)}a {chr(c)}1 e{chr(c)}" for c in points[at : at + 256]]
        for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(enc.encode(text), "<u4").tolist() == want.ids, (hex(ord(text[1])), text)


def test_packing(spark, sf, texts):
    _check_packing(queries.op2_best_fit_packing(spark, sf).collect(), texts, _library(BYTE))


def _best_fit_decreasing(lengths, capacity):
    """The gaps of all sequences, by a plain search through all of them for each piece."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits)[1]] -= n
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_packing_equals_best_fit_decreasing(spark, capacity):
    rng = np.random.default_rng(capacity)
    lengths = [int(x) for x in np.minimum(capacity, np.maximum(1, rng.lognormal(np.log(capacity / 6), 1.2, 900).astype(int)))]
    df = spark.createDataFrame([(i, n, "x", 1, 2) for i, n in enumerate(lengths)], "doc_id long, length long, row string, part int, gap int")
    got = packing.best_fit(df, capacity).collect()
    assert got[0].asDict().keys() == {"doc_id", "length", "row", "part", "gap", "sequence_id", "offset"} and sorted(r.doc_id for r in got) == list(range(900))
    left = Counter()
    for r in got:
        left[r.sequence_id] += r.length
    assert sorted(capacity - n for n in left.values()) == _best_fit_decreasing(lengths, capacity)
    in_parts = {r.sequence_id for r in packing.best_fit(df, capacity, part_rows=100).collect()}
    assert len(left) <= len(in_parts) <= len(left) + 9  # a part for 100 rows each may leave one more open


def test_equal_rows_are_packed_each_and_spread(spark):
    same = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(700).cast("long").alias("length"))
    got = packing.best_fit(same, part_rows=500).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 3000 and {r.offset for r in got} == {0, 700}
    assert len({r.sequence_id for r in got}) <= 1506 and len({r.sequence_id >> 32 for r in got}) > 3


def test_packing_of_odd_texts(spark, odd):
    digests = packing.tokenize(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), BYTE).selectExpr("doc_id", "piece", "start", "length", "crc32(ids) as ids_crc32")
    _check_packing(packing.best_fit(digests).collect(), dict(enumerate(ODD)), _library(BYTE))
    repeated = packing.best_fit(packing.tokenize(odd, BYTE).drop("ids"), part_rows=1).collect()
    assert len({(r.sequence_id, r.offset) for r in repeated}) == len(repeated) >= len(ODD) + 2
    assert packing.best_fit(packing.tokenize(odd.limit(0), BYTE).drop("ids")).count() == 0


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_rules_count_as_brute_force(spark, sf, texts, odd):
    got = queries.op3_quality_rules(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    good = [r.kept for r in got if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in got if labels.get(r.doc_id) == 0]
    assert np.mean(good) > 0.85 and np.mean(bad) < 0.5
    for r in text_stats(odd).where("doc_id is not null").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _base(ODD[r.doc_id])[:5]


def test_rules_without_labels_or_rows(spark, odd):
    labels = spark.createDataFrame([(0, None)], "doc_id long, quality int")
    stats = text_stats(odd)
    assert all(r.kept != r.base_failed for r in quality_rules.judge_stats(stats, quality_rules.fit(stats, labels)).collect())
    assert quality_rules.judge_stats(stats.limit(0), quality_rules.fit(stats.limit(0), labels)).count() == 0


def test_classifier_on_held_out_labels(spark, sf="/root/testdata/sf0.01"):
    labels = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    got = queries.op1_quality_classifier(spark, sf).collect()
    assert len(got) == duckdb.sql(f"select count(*) from '{sf}/documents.parquet'").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and labels.get(r.doc_id) is not None]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.85


def test_classifier_edges(spark, odd):
    stats = text_stats(odd)
    label = lambda rows: quality_classifier.fit(stats, spark.createDataFrame(rows, "doc_id long, quality int"))
    scores = lambda m: {r.score for r in quality_classifier.score_stats(stats, m).collect()}
    assert scores(label([(0, None)])) == {0.5} and scores(label([(3, 1)])) == {1.0} and scores(label([(3, 0), (999, 1)])) == {0.0}
    both = quality_classifier.score_stats(stats, label([(3, 1), (4, 1), (5, 0), (9, 0), (5, 0)])).collect()
    assert len(both) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in both)


def _labelled(sf):
    rows = duckdb.sql(f"select l.doc_id, l.quality, d.text from '{sf}/labels.parquet' l join '{sf}/documents.parquet' d using (doc_id) where l.quality in (0, 1)").fetchall()
    return [r[0] for r in rows], np.array([r[1] for r in rows]), features(np.array([counts_of(r[2]) for r in rows]))


def test_classifier_as_a_plain_discriminant(spark, sf, texts):
    """Means, shrunken covariances and log densities by numpy's own functions, over the labelled rows that may be learnt from."""
    ids, y, x = _labelled(sf)
    learn = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in ids])

    def log_density(k, rows):
        own = x[learn & (y == k)]
        cov = np.cov(own, rowvar=False, bias=True)
        cov = np.where(np.eye(len(cov), dtype=bool), cov + 1e-4, 0.9 * cov)
        from_mean = rows - own.mean(0)
        return np.log(len(own) / learn.sum()) - np.linalg.slogdet(cov)[1] / 2 - (from_mean * np.linalg.solve(cov, from_mean.T).T).sum(1) / 2

    got = {r.doc_id: r for r in queries.op1_quality_classifier(spark, sf).collect()}
    assert got.keys() == texts.keys()
    rows = features(np.array([counts_of(texts[i]) for i in got]))
    want = 1 / (1 + np.exp(-np.clip((log_density(1, rows) - log_density(0, rows)) / rows.shape[1], -600, 600)))
    assert np.allclose([r.score for r in got.values()], want, atol=1e-9)
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())


def _path(tree, row):
    """The leaf's value that one row comes to, node by node, and the depth of the leaf."""
    feature, split, left, value = tree
    at = depth = 0
    while feature[at] >= 0:
        at, depth = left[at] + bool(row[feature[at]] >= split[at]), depth + 1
    return at, value[at], depth


def test_trees_as_counted_by_hand():
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(size=(60, 3)), np.full((5, 3), 0.5), np.full((1, 3), 9.0)])
    tree = quality_rules._tree(points, np.full(3, -4.0), np.full(3, 10.0), 12, rng)
    leaves = [_path(tree, p) for p in points]
    reached = Counter(at for at, _, _ in leaves)
    mean_path = lambda n: 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    for at, value, depth in leaves:
        assert abs(value - depth - mean_path(reached[at])) < 1e-12 and (depth == 12 or reached[at] == 1)
    far = [np.mean([_path(quality_rules._tree(points, np.full(3, -4.0), np.full(3, 10.0), 12, rng), p)[1] for _ in range(60)]) for p in (points[-1], np.zeros(3))]
    assert far[0] < far[1]


def test_rules_as_a_plain_forest(spark, sf, texts):
    """Every text's verdict by a walk through each tree, and the threshold by a search over all cuts of the labelled scores."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stats = text_stats(spark.read.parquet(f"{sf}/documents.parquet"))
    forest = quality_rules.fit(stats, labels)

    def score(x):
        return 2 ** -(np.mean([_path(t, x)[1] for t in forest.trees]) / forest.unit)

    names = [FEATURES.index(f) for f in quality_rules.RULES]
    counts = {i: counts_of(t) for i, t in texts.items()}
    rows = dict(zip(counts, features(np.array(list(counts.values())))[:, names], strict=True))
    scores = {i: score(x) for i, x in rows.items()}
    got = {r.doc_id: r for r in quality_rules.judge_stats(stats, forest).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        words, repeats = len(re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")), counts[i][4]
        assert abs(r.anomaly - scores[i]) < 1e-9 and r.base_failed == (words < 20 or 100 * repeats > 30 * words)
        assert r.kept == (not r.base_failed and r.anomaly < forest.threshold)
    ids, y, _ = _labelled(sf)
    bins = np.array([min(int(scores[i] * quality_rules.BINS), quality_rules.BINS - 1) for i in ids])
    gain = [np.mean(bins[y == 1] < cut) + np.mean(bins[y == 0] >= cut) for cut in range(quality_rules.BINS + 1)]
    cut = forest.threshold * quality_rules.BINS
    assert max(gain[int(np.floor(cut))], gain[int(np.ceil(cut))]) >= max(gain) - 1e-9
    assert 0 < len(forest.trees) == 100 and forest.unit > 1


def test_rules_pick_rows_for_the_trees_by_their_hash(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), *(F.lit(1).alias(c) for c in quality_rules.COUNTS)).repartition(40)
    got = [r.h for r in quality_rules._smallest(df, 100).collect()]
    assert got == sorted(r.h for r in df.select(F.xxhash64("doc_id").alias("h")).collect())[:100]
    assert quality_rules._smallest(df, 5900).count() == 5900 and quality_rules._smallest(df, 10_000).count() == 6000
    assert quality_rules._smallest(df.limit(0), 5).count() == 0


def test_tokenizer_takes_each_text_in_one_call_and_keeps_nothing_of_it():
    tokenizer = packing.Tokenizer(BYTE)
    plain, calls = tokenizer.plain, []
    tokenizer.plain = lambda x: calls.append(x) or plain(x)
    texts = [" ".join(f"w{i}x{k}," for k in range(100)) for i in range(300)]
    tokenizer.encode(texts[0])
    tracemalloc.start()
    for text in texts[1:]:
        tokenizer.encode(text)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert calls == texts
    assert kept < 200_000  # 30,000 different words take megabytes


def test_tokenizer_splits_white_space_and_all_code_points_as_the_library_does():
    lib, tokenizer = _library(BYTE), packing.Tokenizer(BYTE)
    rng = random.Random(3)
    parts = [" ", "\n", "  ", "\n\n", "\t", "\x1c", "\x85", "\xa0", " ", "　", "a", "Bc", "1", "23", "'", "'s", "'ll", "!?", "é", "中", "😀", "́", "​", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts[:4] * 2 + parts[10:23] if i % 2 else parts, k=rng.randint(1, 12))) for i in range(20_000)]
    points = [c for c in range(1, 0x32000) if not 0xD800 <= c < 0xE000]
    texts += [" ".join(f"a{chr(c)}a {chr(c)}1" for c in points[at : at + 16]) for at in range(0, len(points), 16)]
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(tokenizer.encode(text), "<u4").tolist() == want.ids, ascii(text)
