"""Follow-the-regularised-leader (FTRL-proximal) logistic regression over hashed sparse features."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed features; a model holds at most this many weights.
BITS = 18
DIM = 1 << BITS
#: Documented bound of a training sample: labelled documents.
SAMPLE_ROWS = 8_000


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """Per-coordinate learning rates, L1 and L2; weights follow lazily from the accumulated gradients."""

    def __init__(self, dim: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.1):
        self.z, self.n = np.zeros(dim), np.zeros(dim)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> float:
        z, n = self.z[at], self.n[at]
        w = self._weights(z, n)
        p = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, float(w @ x)))))
        g = (p - y) * x
        more = g * g
        self.z[at] = z + g - (np.sqrt(n + more) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + more
        return p

    @property
    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int, epochs: int = 3, **settings) -> np.ndarray:
    """Weights after epochs over the rows (distinct feature numbers, values), in a fixed shuffled order each."""
    model, order = Ftrl(dim, **settings), np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            model.update(rows[i][0], rows[i][1], float(labels[i]))
    return model.weights


def training_sample(docs: DataFrame, labels: DataFrame, marks: list[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text and the marks of a bounded sample of labelled documents, the first by a hash of their ids.

    Rows with a null id or mark teach nothing; of several labels of one id, the largest counts; of several documents
    of one id, the one with the smallest text.
    """
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(m).cast("int").alias(m) for m in marks]).na.drop()
    there = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.first(m).alias(m) for m in marks])


def learned_part(labels: DataFrame, folds: int = 5) -> DataFrame:
    """Labels that may be learned from: rows whose crc32(doc_id as text) mod folds is not 0."""
    return labels.where(~held_out("doc_id", folds))


def held_out(column: str, folds: int = 5):
    """Whether crc32(doc_id as text) mod folds is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == 0, F.lit(False))
