"""Connected components: forests inside blocks of edges, alternated with large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges that a task holds when it reduces a block to a forest.
BLOCK = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) reduced to one link from each node to the smallest that it reaches."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, root):
            break
        root = new
    off = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[off], nodes[root[off]]


def _block_forests(edges: DataFrame) -> DataFrame:
    """Edges with the same components, every block of at most BLOCK edges of a partition replaced by its forest."""

    def run(batches):
        held, size = [], 0

        def out():
            a, b = forest(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))
            return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if held and size + len(batch) > BLOCK:
                yield out()
                held, size = [], 0
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            size += len(batch)
        if size:
            yield out()

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(run, "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    rest = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return own.union(rest).where("a <> b").distinct()


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node either points at one root or is one; repeated edges do not matter."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", F.lit(None).cast("long")))
    seen = ends.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("ends"), F.count("root").alias("ups"))
    return seen.where("low < high or ups > 0 and ends > ups").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node that a path reaches.

    Every block of edges is first reduced to its forest inside its task; a round is two aggregations and two joins
    over the forests, then their blocks again. The number of rounds grows with the logarithm of the longest path.
    Edges stay distributed; each round is cut by a checkpoint. No edges give no rows; null ends are left out.
    """
    now = cut(_block_forests(edges.where("a <> b").distinct()))
    while not _all_stars(now):
        now = cut(_block_forests(_small_star(_large_star(now))))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
