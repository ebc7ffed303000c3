"""Quality classifier: hashed n-grams of words and of word shapes, learned by FTRL, scored as sparse dot products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ftrl
from .common import only
from .text import NOT_SPACE, chunks, mix, span_hashes

#: Features of each token: word, word pair, shape, shape pair, shape triple.
PER_TOKEN = 5
#: A feature's value is its share of the document's tokens times this.
SCALE = 20.0
BIAS = ftrl.DIM
#: A document is predicted good from this score on.
THRESHOLD = 0.3

_CLASS = np.full(256, 2, np.uint8)
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[~NOT_SPACE] = 0
_UPPER, _LOWER, _DIGIT = (np.array([lo <= i <= hi for i in range(256)]) for lo, hi in ((65, 90), (97, 122), (48, 57)))


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (tokens x PER_TOKEN) and the bounds of each document's tokens.

    A token is a run of letters and digits or a run of punctuation. Its shape is its case, whether it has digits, its
    length class, and whether it repeats the token before it; a punctuation run is its own shape.
    """
    if not len(buf):
        return np.zeros((0, PER_TOKEN), np.int64), np.zeros(len(off), np.int64)
    kind = _CLASS[buf]
    turn = np.ones(len(buf), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[off[:-1][off[:-1] < len(buf)]] = True
    a = np.flatnonzero(turn)
    b = np.append(a[1:], len(buf))
    there = kind[a] > 0
    a, b = a[there], b[there]
    bounds = np.searchsorted(a, off)
    h = span_hashes(buf, a, b)
    before = np.zeros(len(h), np.uint64)
    before[1:] = h[:-1]
    head = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[head] = 1
    size = b - a

    def count(which: np.ndarray) -> np.ndarray:
        total = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(which[buf], out=total[1:])
        return total[b] - total[a]

    upper, lower, digit = count(_UPPER), count(_LOWER), count(_DIGIT)
    case = np.where(upper == 0, 0, np.where((lower == 0) & (size > 1), 2, np.where((upper == 1) & _UPPER[buf[a]], 1, 3)))
    word = (case * 2 + (digit > 0)) * 4 + np.minimum(size // 4, 3)
    shape = np.where(kind[a] == 2, h, word.astype(np.uint64)) * np.uint64(2) + (h == before)
    last = np.zeros(len(h), np.uint64)
    last[1:] = shape[:-1]
    last[head] = 3
    pair = mix(shape * np.uint64(31) + last * np.uint64(0x9E3779B97F4A7C15))
    earlier = np.zeros(len(h), np.uint64)
    earlier[1:] = pair[:-1]
    earlier[head] = 5
    mask = np.uint64(ftrl.DIM - 1)
    parts = [h, h + before * np.uint64(0xD6E8FEB86659FD93), shape ^ np.uint64(0xA5A5A5A5), pair, shape + earlier * np.uint64(0xCA5A826395121157)]
    return np.stack([(mix(p + np.uint64(k)) & mask).astype(np.int64) for k, p in enumerate(parts)], axis=1), bounds


def train(docs: DataFrame, labels: DataFrame, mark: str = "quality", rows: int = ftrl.SAMPLE_ROWS) -> np.ndarray:
    """DIM + 1 weights (the last is the bias), learned in one task from a sample of at most rows labelled documents.

    Rows without an id or a label teach nothing; without any labelled document all weights are zero.
    """

    def learn(batches):
        data, y = [], []
        for batch in batches:
            labels = batch.column(2).to_numpy(zero_copy_only=False)
            for i, _, buf, off in chunks(batch.column(1)):
                feats, bounds = features(buf, off)
                for d in range(len(bounds) - 1):
                    own = feats[bounds[d] : bounds[d + 1]]
                    at, n = np.unique(own, return_counts=True)
                    data.append((np.append(at, BIAS).astype(np.int32), np.append(n * (SCALE / max(1, len(own))), 1.0).astype(np.float32)))
                    y.append(labels[i + d])
        w = ftrl.fit(data, np.array(y), ftrl.DIM + 1, l1=1.0)
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(at), pa.array(w[at])], ["at", "w"])

    sample = ftrl.training_sample(docs, labels, [mark], rows).select("doc_id", "text", F.col(mark).cast("double"))
    found = sample.repartition(1).sortWithinPartitions("doc_id").mapInArrow(learn, "at long, w double").toPandas()
    weights = np.zeros(ftrl.DIM + 1)
    weights[found["at"].to_numpy(dtype=np.int64)] = found["w"].to_numpy(dtype=np.float64)
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id and score (0 to 1) for every row, repeated rows and null ids too.

    An empty or null text gets the bias alone; an empty table gives no rows; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = sent.value
        for batch in batches:
            out = np.zeros(len(batch))
            for i, j, buf, off in chunks(batch.column(1)):
                feats, bounds = features(buf, off)
                # each document is summed by itself, so that its score does not depend on its neighbours
                full = np.flatnonzero(np.diff(bounds))
                if len(full):
                    out[i + full] = np.add.reduceat(w[feats].sum(axis=1), bounds[full]) * SCALE / np.diff(bounds)[full]
            yield pa.record_batch([batch.column(0), pa.array(ftrl.sigmoid(out + w[BIAS]))], ["doc_id", "score"])

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
