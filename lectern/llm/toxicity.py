"""Toxicity by a classifier chain: each category's linear model sees the probabilities of the categories before it.

The probabilities that later models learn from are out of fold: each comes from a model that did not see the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ftrl
from .common import unused
from .text import ALNUM, LOWER, chunks, mix, span_hashes, word_spans

#: Byte lengths of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6, 7)
FOLDS = 3
#: Probability of the category "toxic" from which a document is rejected.
REJECT = 0.3


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) pairs: lower-cased words, their beginnings, and the document's length class."""
    low = LOWER[buf]
    a, b, bounds = word_spans(low, off, ALNUM)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    ids, docs = [span_hashes(low, a, b)], [doc]
    for n in PREFIXES:
        long = b - a > n
        ids.append(span_hashes(low, a[long], a[long] + n) + np.uint64(n))
        docs.append(doc[long])
    size = np.log2(np.diff(bounds) + 1).astype(np.uint64)
    ids.append(size + np.uint64(1 << 40))
    docs.append(np.arange(len(off) - 1))
    return np.concatenate(docs), (mix(np.concatenate(ids)) & np.uint64(ftrl.DIM - 1)).astype(np.int64)


def counted(doc: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs and their values, which grow with the logarithm of the count."""
    both, n = np.unique(doc * ftrl.DIM + feature, return_counts=True)
    return both // ftrl.DIM, both % ftrl.DIM, 1.0 + np.log2(n)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _dots(rows, weights: np.ndarray) -> np.ndarray:
    return np.array([weights[at] @ x for at, x in rows])


def chain_row(at: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A document's features with room for the logits of the k - 1 earlier categories, zero until known, and the bias."""
    more = [*range(ftrl.DIM, ftrl.DIM + k - 1), ftrl.DIM + k]
    return np.append(at, more).astype(np.int32), np.append(x, [0.0] * (k - 1) + [1.0]).astype(np.float32)


def fit_chain(rows, marks: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """Weights (categories x (DIM + categories + 1)): hashed features, logits of earlier categories, bias.

    rows come from chain_row; the logits are written into them in place.
    """
    n, k = marks.shape
    dim = ftrl.DIM + k + 1
    fold = np.arange(n) % folds
    chain = []
    for c in range(k):
        chain.append(ftrl.fit(rows, marks[:, c], dim, l1=2.0))
        if c + 1 == k:
            break
        unseen = np.zeros(n)
        for f in range(folds):
            seen = np.flatnonzero(fold != f)
            w = ftrl.fit([rows[i] for i in seen], marks[seen, c], dim, l1=2.0)
            own = np.flatnonzero(fold == f)
            unseen[own] = _dots([rows[i] for i in own], w)
        for (_, x), v in zip(rows, _logit(ftrl.sigmoid(unseen)) / 4):
            x[c - k] = v
    return np.stack(chain)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = ftrl.SAMPLE_ROWS) -> np.ndarray:
    """A chain over the categories (0/1 columns of labels, in chain order), learned in one task from a bounded sample.

    Rows without an id or a label teach nothing; without any labelled document all weights are zero.
    """
    k = len(categories)

    def learn(batches):
        data, marks = [], []
        for batch in batches:
            marks.append(np.stack([batch.column(2 + c).to_numpy(zero_copy_only=False) for c in range(k)], axis=1))
            for _, _, buf, off in chunks(batch.column(1)):
                doc, at, x = counted(*features(buf, off))
                cuts = np.searchsorted(doc, np.arange(len(off)))
                data += [chain_row(at[i:j], x[i:j], k) for i, j in zip(cuts[:-1], cuts[1:])]
        if not data:
            return
        w = fit_chain(data, np.concatenate(marks).astype(float))
        c, at = np.nonzero(w)
        yield pa.record_batch([pa.array(c), pa.array(at), pa.array(w[c, at])], ["c", "at", "w"])

    sample = ftrl.training_sample(docs, labels, categories, rows).select("doc_id", "text", *[F.col(c).cast("double") for c in categories])
    found = sample.repartition(1).sortWithinPartitions("doc_id").mapInArrow(learn, "c long, at long, w double").toPandas()
    weights = np.zeros((k, ftrl.DIM + k + 1))
    weights[found["c"].to_numpy(dtype=np.int64), found["at"].to_numpy(dtype=np.int64)] = found["w"].to_numpy(dtype=np.float64)
    return weights


def chain_scores(buf: np.ndarray, off: np.ndarray, weights: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Probabilities (documents x categories); used: the hashed features with any weight."""
    n, k = len(off) - 1, len(weights)
    doc, at = features(buf, off)
    keep = used[at]
    doc, at, x = counted(doc[keep], at[keep])
    out = np.zeros((n, k))
    for c, w in enumerate(weights):
        total = np.bincount(doc, w[at] * x, n) + w[-1]
        for e in range(c):
            total += w[ftrl.DIM + e] * _logit(out[:, e]) / 4
        out[:, c] = ftrl.sigmoid(total)
    return out


def scores(weights: np.ndarray, spark: SparkSession):
    """A function of the text column: the array of its probabilities by the chain. Only the text travels to Python."""
    sent = spark.sparkContext.broadcast(weights)

    @F.arrow_udf("array<double>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w = sent.value
        used = (w[:, : ftrl.DIM] != 0).any(axis=0)
        for column in texts:
            out = np.zeros((len(column), len(w)))
            for i, j, buf, off in chunks(column):
                out[i:j] = chain_scores(buf, off, w, used)
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * len(w)), pa.array(out.ravel()))

    return run


def score(docs: DataFrame, weights: np.ndarray, categories: list[str], prefix: str = "p_") -> DataFrame:
    """All columns of docs and p_<category> (or another prefix) for each category, for every row.

    A null or empty text is scored by its length class and the bias; columns that carry the new names are replaced.
    Null ids and repeated rows are scored like any other; an empty table gives no rows.
    """
    names = [f"{prefix}{c}" for c in categories]
    kept = docs.drop(*names)
    (found,) = unused(docs, "chain")
    scored = kept.withColumn(found, scores(weights, docs.sparkSession)(F.col("text")))
    return scored.select(*[F.col(f"`{c}`") for c in kept.columns], *[F.get(found, F.lit(c)).alias(n) for c, n in enumerate(names)])


def learned(weights: np.ndarray, categories: list[str]) -> bool:
    """Whether the chain can tell toxic documents at all."""
    return bool(weights[categories.index("toxic")].any())


def without_toxic(docs: DataFrame, weights: np.ndarray, categories: list[str], reject: float = REJECT) -> DataFrame:
    """docs without the rows whose probability of "toxic" reaches reject; all columns are kept as they are.

    A chain that has learned nothing (no labels) rejects no row. Null and empty texts, null ids and repeated rows are
    judged like any other; an empty table gives no rows.
    """
    at = categories.index("toxic")
    if not learned(weights, categories):
        return docs
    return docs.where(F.get(scores(weights, docs.sparkSession)(F.col("text")), F.lit(at)) < reject)


def label_categories(labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """The categories that the labels table can tell, in chain order: degraded text, toxic, and both at once."""
    bad = F.col("quality") == 0
    marked = labels.select("doc_id", bad.cast("int").alias("degraded"), F.col("toxic").cast("int").alias("toxic"), (bad & (F.col("toxic") == 1)).cast("int").alias("toxic_degraded"))
    return marked, ["degraded", "toxic", "toxic_degraded"]
