"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class gets a mean and a shrinkage covariance; a score is the difference of the two Gaussian log densities
(Mahalanobis distances through Cholesky factors that are computed once and shipped with the tasks) plus the log
ratio of the class sizes. Spark sums the moments over every labelled row, so nothing is sampled and the driver
receives a few hundred numbers whatever the size of the corpus.

Defined results: null and empty texts get the score of a text without words. Null labels are left out; labels of
unknown documents have no effect; repeated labels count each time. Repeated documents give repeated rows. With
labels of one class only, every score is 1 or 0 for that class, and without any label 0.5. An empty table gives
an empty result. Further columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text_stats import COUNTS, FEATURES, features, where_counts


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and offsets of the classes 0 and 1, or a constant score without both classes."""

    means: np.ndarray | None
    factors: np.ndarray | None
    offsets: np.ndarray | None
    constant: float = 0.5

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1: the logistic function of the mean log-density difference a feature; 0.5 is even odds."""
        x = features(counts)
        if self.means is None:
            return np.full(len(x), self.constant)
        log = [self.offsets[k] - 0.5 * (((x - self.means[k]) @ self.factors[k].T) ** 2).sum(1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / x.shape[1], -600, 600)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count, sums and products of each class in one partition, a row for each number."""
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False)
        x = features(np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))]))
        for k in (0, 1):
            part = x[y == k]
            total[k] += np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
    n = total.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], n)), pa.array(np.tile(np.arange(n), 2)), pa.array(total.ravel())], ["k", "i", "v"])


def fit(stats: DataFrame, labels: DataFrame, shrinkage: float = 0.1, ridge: float = 1e-4) -> Discriminant:
    """Fit on every row of ``labels`` (doc_id, quality) that has a row in ``stats``.

    ``shrinkage`` is the share of the diagonal in each covariance; ``ridge`` is added to the variances.
    """
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality"))
    joined = stats.join(known, "doc_id").select("quality", *COUNTS)
    sums = joined.mapInArrow(_moments, "k long, i long, v double").groupBy("k", "i").agg(F.sum("v").alias("v")).collect()
    d = len(FEATURES)
    total = np.zeros((2, 1 + d + d * d))
    for r in sums:
        total[r.k, r.i] = r.v
    n = total[:, 0]
    if not n.all():
        return Discriminant(None, None, None, float(n[1] > 0) if n.any() else 0.5)
    means, factors, offsets = [], [], []
    for k in (0, 1):
        mean = total[k, 1 : 1 + d] / n[k]
        cov = total[k, 1 + d :].reshape(d, d) / n[k] - np.outer(mean, mean)
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + ridge * np.eye(d)
        chol = np.linalg.cholesky(cov)
        means.append(mean)
        factors.append(np.linalg.inv(chol))
        offsets.append(np.log(n[k] / n.sum()) - np.log(np.diag(chol)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(offsets))


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_stats(stats: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(COUNTS))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(counts))], ["doc_id", "score"])

    out = stats.select("doc_id", *COUNTS).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_rows(docs: DataFrame, model: Discriminant, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, columns as they are."""
    return where_counts(docs, lambda counts: model.score(counts) >= least)
