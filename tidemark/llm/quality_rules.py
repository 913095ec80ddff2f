"""Quality rules: base rules on exact counts, then an isolation forest over rule statistics.

Each tree splits at random places of the range that the whole corpus spans, and counts how many of a few hundred
texts labelled good reach each node. A text that random splits part from them early has a short path and is an
anomaly. The threshold is calibrated on all labelled rows.

Defined results: null and empty texts have zero counts and fail the base rules. Null labels are left out. Without
texts labelled good the forest rejects nothing, and without texts labelled bad only what no good text reaches. An
empty table gives an empty result. Repeated rows are judged alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.text_stats import COUNTS, FEATURES, features, where_counts

RULES = ["word_length", "symbols", "bangs", "upper", "same_word"]
_AT = [FEATURES.index(x) for x in RULES]
BINS = 4000


def average_path(n: int) -> float:
    """Mean path length of a random binary tree over ``n`` points."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: feature (-1 at a leaf), split, left child; the right child follows the left. value: path length at a leaf."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    unit: float
    depth: int
    threshold: float = np.inf

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 to 1: two to the power of minus the mean path length in units."""
        x = features(counts)[:, _AT]
        if not self.trees:
            return np.zeros(len(x))
        rows, total = np.arange(len(x)), np.zeros(len(x))
        for feature, split, left, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, left[node] + (x[rows, np.maximum(f, 0)] >= split[node]), node)
            total += value[node]
        return 2 ** (-total / len(self.trees) / self.unit)


def _tree(points: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
    feature, split, left, value = [], [], [], []

    def leaf() -> int:
        for x, v in ((feature, -1), (split, 0.0), (left, 0), (value, 0.0)):
            x.append(v)
        return len(feature) - 1

    todo = [(leaf(), points, low, high, 0)]
    while todo:
        at, here, lo, hi, d = todo.pop()
        value[at] = d + average_path(len(here))
        if d >= depth or len(here) <= 1:
            continue
        f = int(rng.integers(here.shape[1]))
        s = float(rng.uniform(lo[f], hi[f]))
        below, above = hi.copy(), lo.copy()
        below[f] = above[f] = s
        feature[at], split[at], left[at] = f, s, leaf()
        right = leaf()
        todo += [(left[at], here[here[:, f] < s], lo, below, d + 1), (right, here[here[:, f] >= s], above, hi, d + 1)]
    return np.array(feature), np.array(split), np.array(left), np.array(value)


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([batch.column(i + first).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = features(_matrix(batch, 0))[:, _AT]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(RULES))), pa.array(x.min(0)), pa.array(x.max(0))], ["i", "lo", "hi"])


def fit(stats: DataFrame, labels: DataFrame, n_trees: int = 100, tree_rows: int = 256, depth: int = 12, fit_rows: int = 25_600, seed: int = 1) -> Forest:
    """Grow the forest and set its threshold.

    Trees are grown on at most ``fit_rows`` rows labelled good (those with the smallest hash of doc_id), of which each
    takes ``tree_rows`` at random. The ranges cover every row of ``stats``; the threshold, every labelled row.
    """
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality"))
    scratch = Scratch(stats.sparkSession, "rules")
    try:
        return _grow(stats, scratch.table(stats.join(known, "doc_id"), "labelled"), n_trees, tree_rows, depth, fit_rows, seed)
    finally:
        scratch.remove()


def _smallest(good: DataFrame, fit_rows: int) -> DataFrame:
    """The ``fit_rows`` rows with the smallest hash of doc_id, or a few less where one doc_id repeats very often.

    Only hashes below a cut that 1.05 times as many rows are expected to pass get to the sort, so that one task reads
    little more than ``fit_rows`` rows however many partitions and rows there are.
    """
    hashed = good.select(F.xxhash64("doc_id").alias("h"), *COUNTS)
    total = good.count()
    if total > 1.05 * fit_rows:
        hashed = hashed.where(F.col("h") < int(-(2**63) + 1.05 * fit_rows / total * 2**64))
    return hashed.orderBy("h", *COUNTS).limit(fit_rows)


def _grow(stats: DataFrame, joined: DataFrame, n_trees: int, tree_rows: int, depth: int, fit_rows: int, seed: int) -> Forest:
    rows = _smallest(joined.where("quality = 1"), fit_rows).toPandas()
    if not len(rows):
        return Forest([], 1.0, 0)
    box = stats.select(*COUNTS).mapInArrow(_ranges, "i long, lo double, hi double").groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("i").collect()
    low, high = np.array([r.lo for r in box]), np.array([r.hi for r in box])
    good, rng = features(rows[COUNTS].to_numpy())[:, _AT], np.random.default_rng(seed)
    take = min(tree_rows, len(good))
    trees = [_tree(good[rng.choice(len(good), take, replace=False)], low, high, depth, rng) for _ in range(n_trees)]
    forest = Forest(trees, max(average_path(take), 1.0), depth)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.minimum((forest.score(_matrix(batch, 1)) * BINS).astype(np.int64), BINS - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at)], ["quality", "bin"])

    found = joined.select("quality", *COUNTS).mapInArrow(binned, "quality long, bin long").groupBy("quality", "bin").count().collect()
    hist = np.zeros((2, BINS))
    for r in found:
        hist[r.quality, r.bin] = r["count"]
    return Forest(trees, forest.unit, depth, _threshold(hist))


def _threshold(hist: np.ndarray) -> float:
    """The middle of the bins' edges at which good texts below and bad texts above it are, as shares, most."""
    good, bad = hist[1], hist[0]
    below = np.concatenate([[0], np.cumsum(good)]) / max(good.sum(), 1)
    above = np.concatenate([[bad.sum()], bad.sum() - np.cumsum(bad)]) / max(bad.sum(), 1)
    gain = below + above
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    run = best[: np.flatnonzero(np.diff(best) > 1)[0] + 1] if (np.diff(best) > 1).any() else best
    return float(run[0] + run[-1]) / 2 / BINS


def base_failed(counts: np.ndarray, min_words: int = 20, max_repeat_percent: int = 30) -> np.ndarray:
    """Fewer than ``min_words`` words, or more than ``max_repeat_percent`` % of them in repeated windows."""
    words, repeats = counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")]
    return (words < min_words) | (100 * repeats > max_repeat_percent * words)


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, anomaly double, kept boolean"


def judge_stats(stats: DataFrame, forest: Forest) -> DataFrame:
    """The base counts, base_failed, anomaly (the forest's score) and kept for each row of ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _matrix(batch, 1)
            failed, score = base_failed(counts), forest.score(counts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(failed), pa.array(score), pa.array(~failed & (score < forest.threshold))], [x.split()[0] for x in RESULT.split(", ")])

    return stats.select("doc_id", *COUNTS).mapInArrow(run, RESULT)


def keep_rows(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows of ``docs`` whose text passes the base rules and the forest, columns as they are."""
    return where_counts(docs, lambda counts: ~base_failed(counts) & (forest.score(counts) < forest.threshold))
