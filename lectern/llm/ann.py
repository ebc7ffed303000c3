"""Approximate nearest neighbours by multi-index hashing.

Learned rotations turn vectors into binary codes of BITS bits, which are cut into substrings, each with an index from
value to rows. By the pigeonhole principle a code within the search radius is close to the query's in some substring,
so probing each index within its share of the radius retrieves every such code; the floats of these are reranked.
Rows and queries meet block by block, each block with its own index, and a block gives back a query's k best alone:
the pairs inside the radius stay in the task, for their number grows with rows times queries.
"""

from __future__ import annotations

from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documented bound of the rows that the rotations and the radius are fitted on; every row is indexed.
SAMPLE = 8_000
#: Code length, and the lengths that substrings may have.
BITS, WIDTHS = 128, (8, 16)
#: The share of the sample's true neighbours that the radius must hold.
HELD = 0.96
#: Bytes of floats of the rows and of the queries that meet in one task.
ROW_BYTES, QUERY_BYTES = 24 << 20, 8 << 20

def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, x (doubles) and dim of the rows that take part: an id, finite components, not all zero."""
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"))
    return kept.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & finite & F.exists("x", lambda v: v != 0)).withColumn("dim", F.size("x"))


def rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """Iterative quantisation: the rotation that brings the vectors close to the corners of a cube."""
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.sign(x @ r).T @ x)
        r = (u @ v).T
    return r


def projection(x: np.ndarray) -> np.ndarray:
    """A matrix from vectors to BITS numbers whose signs are the code: rotations side by side, or one of the main axes."""
    dim = x.shape[1]
    if dim > BITS:
        axes = np.linalg.eigh(x.T @ x)[1][:, -BITS:]
        return axes @ rotation(x @ axes, 0)
    return np.concatenate([rotation(x, seed) for seed in range(-(-BITS // dim))], axis=1)[:, :BITS]


def encode(x: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Codes as rows of 64-bit words; bit k of a code is bit k % 64 of word k // 64."""
    return np.packbits(x @ turn > 0, axis=1, bitorder="little").view(np.uint64)


def shares(radius: int, m: int) -> list[int]:
    """How far each of m substrings is probed (-1: not at all): they add up to radius - m + 1, so one of them must hold."""
    return [radius // m - (s > radius % m) for s in range(m)]


def fit(x: np.ndarray, rows: int, k: int = 5, held: float = HELD) -> tuple[np.ndarray, int, int]:
    """The projection, the radius that holds that share of the sample's true neighbours, and the substring length.

    Of the lengths the one with the least work counts: probes of a query, and rows that they meet, as the sample has it.
    """
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    turn = projection(x)
    codes = encode(x, turn)
    asked = np.arange(0, len(x), max(1, len(x) // 400))
    far, apart = [], []
    for q in asked.tolist():
        near = x @ x[q]
        near[q] = -2.0
        best = np.argsort(-near)[: min(k, len(x) - 1)]
        far += np.bitwise_count(codes[best] ^ codes[q]).sum(axis=1, dtype=np.int64).tolist()
        apart.append(codes[:: max(1, len(x) // 500)] ^ codes[q])
    radius = int(np.quantile(far, held, method="higher")) if far else BITS
    bits = np.unpackbits(np.concatenate(apart).view(np.uint8).reshape(-1, BITS // 8), axis=1, bitorder="little")

    def work(width: int) -> float:
        own = shares(radius, BITS // width)
        parts = bits.reshape(len(bits), -1, width).sum(axis=2)
        return sum(sum(comb(width, j) for j in range(t + 1)) for t in own) + rows * float((parts <= np.array(own)).mean(axis=0).sum())

    return turn, radius, min(WIDTHS, key=work)


class Index:
    """Rows by the value of each substring of their codes."""

    def __init__(self, codes: np.ndarray, width: int):
        self.codes, self.width = codes, width
        self.values = self.cut(codes)
        self.rows = [np.argsort(v, kind="stable") for v in self.values]
        self.first = [np.concatenate([[0], np.cumsum(np.bincount(v, minlength=1 << width))]) for v in self.values]
        ones = np.bitwise_count(np.arange(1 << width, dtype=np.uint32))
        self.masks, self.within_share = np.argsort(ones, kind="stable"), np.cumsum(np.bincount(ones, minlength=width + 1))

    def cut(self, codes: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(codes.view(np.uint8 if self.width == 8 else np.uint16).astype(np.int64).T)

    def probe(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Which rows the probes of a code touch: at least all within the radius."""
        found = np.zeros(len(self.codes), bool)
        for s, (value, share) in enumerate(zip(self.cut(code[None])[:, 0], shares(radius, len(self.values)))):
            if share < 0:
                continue
            near = value ^ self.masks[: self.within_share[min(share, self.width)]]
            begin = self.first[s][near]
            n = self.first[s][near + 1] - begin
            found[self.rows[s][np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        return np.flatnonzero(found)

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose codes differ from code in at most radius bits."""
        rows = self.probe(code, radius)
        return rows[distances(self.codes[rows], code) <= radius]


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    x = pa.concat_arrays(table["x"].chunks) if table["x"].num_chunks else pa.array([], pa.list_(pa.float64()))
    ids = table["vec_id"].to_numpy()
    return ids, x.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near one: cosines stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None]) if x.size else x


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each query by cosine, nearest first.

    Ties go to the smaller vec_id; rows with a query's own id are no candidates. Vectors without id, null, empty, zero,
    or holding a null or non-finite component take no part. Vectors of each dimension are searched among themselves.
    Repeated queries ask once; repeated rows are candidates each. Where a block holds fewer than k rows inside
    a query's radius, its nearest codes beyond it count too. Empty tables give no rows.
    """
    there = {r["dim"]: r["count"] for r in usable(vectors).groupBy("dim").count().collect()}
    dims = sorted(r["dim"] for r in usable(queries).select("dim").distinct().collect() if r["dim"] in there)
    if not dims:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, [search_dimension(vectors, queries, k, dim, there[dim]) for dim in dims])


def search_dimension(vectors: DataFrame, queries: DataFrame, k: int, dim: int, n_rows: int) -> DataFrame:
    """The search among the n_rows vectors of one dimension."""
    known = usable(vectors).where(F.col("dim") == dim).select("vec_id", "x")
    asked = usable(queries).where(F.col("dim") == dim).select("vec_id", "x").distinct()
    sample = known.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").toArrow()["x"].to_pylist()
    fitted = fit(scaled(np.array(sample, np.float64)), n_rows, k)
    sent = vectors.sparkSession.sparkContext.broadcast(fitted)
    row_blocks, query_blocks = (max(1, -(-n * 8 * dim // size)) for n, size in ((n_rows, ROW_BYTES), (asked.count(), QUERY_BYTES)))

    def meet(rows: pa.Table, questions: pa.Table) -> pa.Table:
        turn, radius, width = sent.value
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(rows) and len(questions):
            ids, x = matrix(rows)
            by = np.argsort(ids, kind="stable")
            ids, x = ids[by], scaled(x[by])
            size = np.sqrt((x * x).sum(axis=1))
            index = Index(encode(x, turn), width)
            asked_ids, q = matrix(questions)
            named = [xxhash.xxh64_intdigest(v.tobytes()) >> 1 for v in q]
            q = scaled(q)
            for query, name, v, code in zip(asked_ids.tolist(), named, q, encode(q, turn)):
                at = index.within(code, radius)
                at = at[ids[at] != query]
                if len(at) < k:
                    other = np.flatnonzero(ids != query)
                    at = np.sort(other[np.argsort(distances(index.codes[other], code), kind="stable")[:k]])
                score = (x[at] * v).sum(axis=1) / (size[at] * np.sqrt((v * v).sum()))
                top = np.argsort(-score, kind="stable")[:k]
                out.append((np.full(len(top), name), np.full(len(top), query), ids[at[top]], score[top]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], ["question", "query_id", "vec_id", "score"])

    left = known.select(F.pmod(F.xxhash64("vec_id", "x"), F.lit(row_blocks)).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "vec_id", "x")
    right = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)).cast("array<bigint>")).alias("rb"), "vec_id", "x")
    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(meet, "question long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id", "question").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
