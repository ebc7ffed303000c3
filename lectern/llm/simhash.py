"""SimHash near-duplicates: fingerprints of word shingles, linked by a pigeonring search.

The 64 bits stand as five segments on a ring. If two fingerprints differ in at most 4 bits, some segment starts a
chain in which the first segment is equal, the first two differ in at most 1 bit, the first three in at most 2, and
so on (a chain of l segments stays within l * 4/5). A fingerprint therefore meets all its partners under keys made of
one exact segment and the next one with a single bit masked; the rest of the chain and the full Hamming check follow
where the keys meet.
"""

from __future__ import annotations

from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, only, unused
from .graph import components, forest
from .text import LOWER, buffers

#: First bit and width of each segment of the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
THRESHOLD = 4
SEED = 42
#: Fingerprints of one key that are compared with others at once.
BLOCK = 128


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The SimHash of a lower-cased text: no words give zero, fewer words than a shingle one shingle."""
    words = text.split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-shingle])]
    h = np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, ends[shingle - 1 :])], repeat(SEED)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        counts += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) for every row."""

    def run(batches):
        for batch in batches:
            buf, off = buffers(batch.column(1))
            data = LOWER[buf].tobytes()
            fps = np.array([fingerprint(data[a:b], shingle) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def ring_keys(fps: np.ndarray) -> np.ndarray:
    """One row for each fingerprint, one key for each chain start and masked bit of the second segment."""
    out = []
    for i, (first, width) in enumerate(SEGMENTS):
        second, bits = SEGMENTS[(i + 1) % len(SEGMENTS)]
        exact = (fps >> np.uint64(first)) & np.uint64((1 << width) - 1)
        near = (fps >> np.uint64(second)) & np.uint64((1 << bits) - 1)
        for j in range(bits):
            masked = near & np.uint64(~(1 << j) & 0xFFFF)
            out.append((((exact << np.uint64(13)) | masked) << np.uint64(8)) | np.uint64(i * 16 + j))
    return np.stack(out, axis=1)


def in_chain(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which differences x stay within the budgets of the chain that begins at segment start, up to the whole ring."""
    parts = np.stack([np.bitwise_count((x >> np.uint64(a)) & np.uint64((1 << w) - 1)) for a, w in SEGMENTS], axis=1).astype(np.int64)
    n = len(SEGMENTS)
    ok, total = np.ones(len(x), bool), np.zeros(len(x), np.int64)
    for step in range(n):
        total += parts[np.arange(len(x)), (start + step) % n]
        ok &= total * n <= (step + 1) * THRESHOLD
    return ok


def meet(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints with equal keys (sorted), as a forest.

    Pairs pass the chain that begins at the key's segment and the full Hamming check; all others are found under
    another key or not at all. A group is compared in blocks, so its memory grows with its size alone.
    """
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(keys)))
    heads, tails = [fps[:0]], [fps[:0]]

    def test(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> None:
        x = a ^ b
        near = np.bitwise_count(x) <= THRESHOLD
        near[near] = in_chain(x[near], ((key[near] & np.uint64(255)) >> np.uint64(4)).astype(np.int64))
        heads.append(a[near])
        tails.append(b[near])

    wide = size > BLOCK
    for i, n in zip(head[wide].tolist(), size[wide].tolist()):
        for at in range(i, i + n, BLOCK):
            own = fps[at : min(at + BLOCK, i + n)]
            for far in range(at, i + n, 64 * BLOCK):
                other = fps[far : min(far + 64 * BLOCK, i + n)]
                p, q = np.nonzero(np.bitwise_count(own[:, None] ^ other) <= THRESHOLD)
                test(own[p], other[q], np.repeat(keys[i : i + 1], len(p)))
            if len(heads) > 64:
                heads[:], tails[:] = ([x] for x in forest(np.concatenate(heads), np.concatenate(tails)))
    at = np.flatnonzero(np.repeat(~wide, size))
    k, f = keys[at], fps[at]
    for step in range(1, int(size[~wide].max(initial=1))):
        ok = np.flatnonzero(k[step:] == k[:-step])
        test(f[ok], f[ok + step], k[ok])
    return forest(np.concatenate(heads), np.concatenate(tails))


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp): a forest with all components of Hamming distance <= 4.

    Keys arrive sorted, so a task holds one batch and the fingerprints of one key at a time.
    """

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(fps), 1 << 14):
                keys = ring_keys(fps[i : i + (1 << 14)])
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fps[i : i + (1 << 14)], keys.shape[1]).view(np.int64))], ["key", "fp"])

    def join(batches):
        keys, fps = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for batch in chain(batches, [None]):
            done = len(keys)
            if batch is not None:
                more = [batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in (0, 1)]
                keys, fps = np.concatenate([keys, more[0]]), np.concatenate([fps, more[1]])
                done = int(np.argmax(keys == keys[-1])) if len(keys) else 0
            a, b = meet(keys[:done], fps[:done])
            keys, fps = keys[done:], fps[done:]
            if len(a):
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    keyed = distinct.select("fp").mapInArrow(deal, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links of at most 4 differing bits) for every row.

    Equal fingerprints are folded to one before the search, so a text with many copies is searched once. A null text
    has no words and the fingerprint zero. A row without doc_id keeps its fingerprint and gets the component of its
    fingerprint; it never names a component, which is null if no row of it has an id. Repeated rows stay repeated. An
    empty table gives no rows; other columns are ignored.
    """
    fps = cut(fingerprints(docs, shingle))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(nodes))
    rooted = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(names, "root").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def without_near_copies(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """One row of each component stays: the one whose doc_id names it. All columns are kept.

    Of repeated rows with that doc_id all but one go. Rows without doc_id cannot name a component and stay.
    """
    found = near_duplicates(docs, shingle).where(F.col("doc_id") == F.col("component_id"))
    (kept_id,) = unused(docs, "kept_id")
    named = cut(found.groupBy("doc_id").count().select(F.col("doc_id").alias(kept_id), "count"))
    kept = docs.join(named.select(kept_id), docs["doc_id"] == F.col(kept_id), "left_semi")
    if not named.where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
