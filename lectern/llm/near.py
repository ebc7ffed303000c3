"""Near copies: SimHash links, and links by word shingles at a Jaccard similarity.

MinHash bands propose pairs of shingle sets, and the similarity of the whole sets decides. A SimHash search alone
cannot serve a similarity of 0.8: such texts differ in about 10 of 64 bits and often in 17, and so wide a distance
leaves the segments of a fingerprint too few bits to search by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import cut, only, unused
from .graph import components
from .text import LOWER, NOT_SPACE, _power_tables, chunks, mix, span_hashes, word_spans

SHINGLE = 5
SIMILARITY = 0.8
#: Bands and the minima in each: a pair at 0.8 shares no band with probability (1 - 0.8 ** 5) ** 36, about 6e-7.
BANDS, ROWS = 36, 5
#: Rounds that compare a band's texts with one leader before the rest are compared with one another.
STARS = 2
#: Texts, and bytes of packed texts, of a block; a task compares two blocks of one band.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Texts up to which a shingle counts as rare.
RARE = 16

_rng = np.random.default_rng(42)
_FLIP = _rng.integers(0, 1 << 32, 4096, np.uint32)
_TIMES = _rng.integers(0, 1 << 32, 4096, np.uint32) | np.uint32(1)


def shingle_sets(buf: np.ndarray, off: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each lower-cased text's shingles; a text with fewer words is one shingle."""
    buf = LOWER[buf]
    a, b, bounds = word_spans(buf, off, NOT_SPACE)
    up, down = _power_tables(len(a))
    prefix = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(span_hashes(buf, a, b) * up[: len(a)], out=prefix[1:])
    out = []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        w = min(shingle, j - i)
        at = np.arange(i, j - w + 1 if w else i)
        out.append(np.unique(mix((prefix[at + w] - prefix[at]) * down[at] + np.uint64(w))))
    return out


def set_id(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).astype(np.int64)) if len(found) else 0


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of minima; none for an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    n = bands * rows
    x = (found ^ (found >> np.uint64(32))).astype(np.uint32)[:, None]
    least = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, ((x[i : i + 512] ^ _FLIP[:n]) * _TIMES[:n]).min(0), out=least)
    key = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T.astype(np.uint64):
        key = mix((key + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ column)
    return key.view(np.int64)


def similar(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts (node, packed) have sets of shingles with at least that Jaccard similarity."""

    def run(batches):
        swell = zstandard.ZstdDecompressor()
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            good = []
            for x, y in zip(left, right):
                x, y = swell.decompress(x.as_py()), swell.decompress(y.as_py())
                x, y = shingle_sets(np.frombuffer(x + y, np.uint8), np.array([0, len(x), len(x) + len(y)]), shingle)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                good.append(both / (len(x) + len(y) - both) >= similarity)
            good = pa.array(good, pa.bool_())
            yield pa.record_batch([a.filter(good), b.filter(good)], ["a", "b"])

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("right")), "b")
    both = both.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share: rare elements pair by pair, the others as products of 0-1 columns."""
    n = len(sets)
    _, element = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_inverse=True)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(element, kind="stable")
    owner = owner[order]
    count = np.bincount(element)
    begin = np.cumsum(count) - count
    out = np.zeros(n * n, np.float32)
    for c in range(2, RARE + 1):
        at = begin[count == c]
        for i in range(0, len(at), max(1, (1 << 20) // (c * c))):
            held = owner[at[i : i + max(1, (1 << 20) // (c * c)), None] + np.arange(c)]
            out += np.bincount((held[:, :, None] * n + held[:, None, :]).ravel(), minlength=n * n).astype(np.float32)
    out = out.reshape(n, n)
    often = np.flatnonzero(count > RARE)
    for i in range(0, len(often), 2048):
        some = often[i : i + 2048]
        column = np.repeat(np.arange(len(some)), count[some])
        rows = owner[np.repeat(begin[some] - (np.cumsum(count[some]) - count[some]), count[some]) + np.arange(int(count[some].sum()))]
        held = np.zeros((n, len(some)), np.float32)
        held[rows, column] = 1
        out += held @ held.T
    return out


def forest(sets: list[np.ndarray], roots: list[int], side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of similar sets that join what roots leave apart: at most one link less than sets.

    side is 0, 1 or 2: sets of sides 1 and 2 are compared with the other side alone, sets of side 0 with all.
    """
    sizes = np.array([len(x) for x in sets], np.float64)
    both = shared_counts(sets)
    whole = sizes[:, None] + sizes[None] - both
    good = np.triu((both / np.maximum(whole, 1) >= similarity) & (whole > 0), 1) & ((side[:, None] != side[None]) | (side[:, None] == 0))
    up = {r: r for r in roots}

    def top(r: int) -> int:
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(good))):
        a, b = top(roots[i]), top(roots[j])
        if a != b:
            up[a] = b
            out.append((i, j))
    return out


def similar_inside(members: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) between similar texts that share a key and stand under different roots; members: key, node, root.

    The texts of a key meet in a task, which compares their sets of shingles and hands on a forest of links, never the
    pairs. A key with more texts than a block is dealt out: each task then has two of its blocks.
    """
    held = members.join(texts, "node")
    sizes = held.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.octet_length("packed")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = held.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "root", "packed")

    def run(group: pa.Table) -> pa.Table:
        swell = zstandard.ZstdDecompressor()
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        sets: list[np.ndarray] = []
        for some in group["packed"].to_pylist():
            raw = swell.decompress(some)
            sets += shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), shingle)
        side = np.zeros(len(sets), np.int64) if low == high else 1 + (group["block"].to_numpy() == high)
        node = group["node"].to_pylist()
        found = [sorted((node[i], node[j])) for i, j in forest(sets, group["root"].to_pylist(), side, similarity)]
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return met.groupBy("key", "low", "high").applyInArrow(run, "a long, b long").distinct()


def linked(shared: DataFrame, texts: DataFrame, links: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of the components of links (a, b) and of similar sets that share a key; shared: key, node, each once.

    Two sets that links already join need no comparison, so a group of near copies costs a comparison with some leaders
    for each; what the leaders leave apart is compared inside tasks. Nodes without a text in texts are in no link;
    without rows there are no components.
    """
    tested, found = None, links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    now = shared.join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    for turn in range(STARS):
        order = F.xxhash64("node", F.lit(turn))
        leaders = now.groupBy("key").agg(F.min(F.struct(order.alias("h"), "node", "root")).alias("lead"))
        pairs = now.join(leaders, "key").where("root <> lead.root").select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct()
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            tested = pairs if tested is None else tested.union(pairs)
            links = links.union(cut(similar(pairs, texts, shingle, similarity)))
        found = components(links)
        now = shared.join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        mixed = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        now = cut(now.join(mixed.select("key"), "key", "left_semi"))
        if now.isEmpty():
            return found
    return components(links.union(cut(similar_inside(now, texts, shingle, similarity))))


def without_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of each component of near copies stays: the one with the smallest doc_id. All columns are kept.

    Two texts are linked if op5_simhash links them, or if their sets of shingles have the Jaccard similarity or more.
    Of repeated rows with the doc_id that stays all but one go. Rows without doc_id cannot name a component and stay.
    """

    def fingerprints(batches):
        for batch in batches:
            for i, j, buf, off in chunks(batch.column(1)):
                found, data, at = shingle_sets(buf, off, shingle), LOWER[buf].tobytes(), off.tolist()
                ids, keys = pa.array([set_id(x) for x in found], pa.int64()), [band_keys(x, bands, rows) for x in found]
                fps = np.array([simhash.fingerprint(data[a:b]) for a, b in zip(at, at[1:])], np.uint64)
                yield pa.record_batch([batch.column(0).slice(i, j - i), ids, pa.array(keys, pa.list_(pa.int64())), pa.array(fps.view(np.int64))], ["doc_id", "node", "keys", "fp"])

    def whole(batches):
        squeeze = zstandard.ZstdCompressor(3)
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(0)):
                data, at = LOWER[buf].tobytes(), off.tolist()
                ids = [set_id(x) for x in shingle_sets(buf, off, shingle)]
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([squeeze.compress(data[a:b]) for a, b in zip(at, at[1:])], pa.binary())], ["node", "packed"])

    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    prints = texts.mapInArrow(fingerprints, "doc_id long, node long, keys array<long>, fp long")
    nodes = cut(prints.groupBy("node", "fp").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys")))
    near_fps = components(simhash.links(nodes.select("fp").distinct()))
    along = nodes.select("fp", "node").join(near_fps.withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("root", "fp").alias("near_fp"))
    links = cut(along.join(along.groupBy("near_fp").agg(F.min("node").alias("b")), "near_fp").where("node <> b").select(F.col("node").alias("a"), "b").distinct())
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    same = Window.partitionBy("key")
    often = keyed.select("key", "node", F.min("node").over(same).alias("low"), F.max("node").over(same).alias("high")).where("low < high")
    shared = cut(often.select("key", "node").distinct())
    one = shared.select("node").distinct()
    ids = nodes.join(one, "node", "left_semi").groupBy("node").agg(F.min("least").alias("doc_id")).select("doc_id").distinct()
    wanted = texts.join(ids, "doc_id", "left_semi").union(texts.where(F.col("doc_id").isNull()))
    packed = cut(wanted.select("text").mapInArrow(whole, "node long, packed binary").join(one, "node", "left_semi").groupBy("node").agg(F.min("packed").alias("packed")))
    found = linked(shared, packed, links, shingle, similarity)
    rooted = nodes.select("node", "least").join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), "least")
    (kept_id,) = unused(docs, "kept_id")
    stay = rooted.groupBy("root").agg(F.min("least").alias(kept_id)).select(kept_id).distinct()
    kept = docs.join(stay, docs["doc_id"] == F.col(kept_id), "left_semi")
    if not kept.select("doc_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
