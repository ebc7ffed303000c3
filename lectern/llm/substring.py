"""Exact substring dedup over windows of words, by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string to the minimiser's bucket; there all windows
are sorted and every one but the earliest of its kind is marked. Equal packed strings of a task are folded to the
earliest before they travel, so copies of a text cost one string per task. The windows of a minimiser with more bytes
than a bucket may hold travel one by one instead, to buckets by the hash of their own words.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GROUP_BYTES, groups_for, only
from .text import NOT_SPACE, _power_tables, chunks, mix, span_hashes, word_spans

WINDOW = 20
#: Bytes of packed strings that a task holds before it sends them on.
HELD_BYTES = 24 << 20
#: Packed strings repeat the words that neighbouring ones share, about so many times the text in all.
EXPANSION = 3


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """The minimum of each k consecutive values."""
    out, done = x, 1
    while done < k:
        step = min(done, k - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def super_windows(buf: np.ndarray, off: np.ndarray, window: int):
    """Runs of windows with one minimiser: document, first window's start word, packed string, minimiser.

    A word's rank puts long words, which are rare, first; ties fall by hash. Runs go by the minimiser's value, so a
    text that repeats one word makes one run.
    """
    a, b, bounds = word_spans(buf, off, NOT_SPACE)
    n = np.diff(bounds)
    if not len(a) or n.max() < window:
        return
    size = b - a
    rank = ((np.uint64(15) - np.minimum(size, 15).astype(np.uint64)) << np.uint64(60)) | (span_hashes(buf, a, b) >> np.uint64(4))
    least = sliding_min(rank, window)
    doc = np.repeat(np.arange(len(n)), n)[: len(least)]
    valid = np.arange(len(least)) + window <= bounds[1:][doc]
    at = np.flatnonzero(valid)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (least[at[1:]] != least[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(new)
    begin, last = at[first], at[np.append(first[1:], len(at)) - 1] + window - 1
    joined = np.full(int(size.sum()) + len(a), 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(a)), size)] = buf[NOT_SPACE[buf]]
    start = np.concatenate([[0], np.cumsum(size + 1)])
    data = joined.tobytes()
    d = doc[begin]
    yield from zip(d.tolist(), (begin - bounds[d]).tolist(), (last - begin + 1).tolist(), [data[i:j] for i, j in zip(start[begin].tolist(), (start[last + 1] - 1).tolist())], least[begin].tolist())


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(document, from, to) with overlapping or touching stretches of one document joined."""
    out: list[list[int]] = []
    for d, i, j in sorted(spans):
        if out and out[-1][0] == d and i <= out[-1][2]:
            out[-1][2] = max(out[-1][2], j)
        else:
            out.append([d, i, j])
    return [tuple(x) for x in out]


def later_windows(docs: np.ndarray, starts: np.ndarray, text: bytes, window: int) -> list[tuple[int, int, int]]:
    """Stretches of words covered by windows that also start earlier; text: packed strings, one a line."""
    buf = np.frombuffer(text, np.uint8)
    ends = np.append(np.flatnonzero(buf == 10), len(buf))
    a, b, bounds = word_spans(buf, np.concatenate([[0], ends]), NOT_SPACE)
    up, down = _power_tables(len(a))
    prefix = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(span_hashes(buf, a, b) * up[: len(a)], out=prefix[1:])
    n = np.diff(bounds) - window + 1
    own = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    at = bounds[:-1][own] + step
    key = mix((prefix[at + window] - prefix[at]) * down[at])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    order = order[twice]
    d, s = docs[own[order]], starts[own[order]] + step[order]
    by = np.lexsort((s, d, key[order]))
    order, d, s = order[by], d[by], s[by]
    k = key[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(k) else np.zeros(0, np.int64)
    i, j = a[at[order]].tolist(), b[at[order] + window - 1].tolist()
    equal = np.fromiter((text[i[x]:j[x]] == text[i[y]:j[y]] for x, y in enumerate(lead.tolist())), bool, len(lead))
    later = equal & ((d != d[lead]) | (s != s[lead]))
    if not equal.all():  # two texts under one hash: sort these by their words
        for x in np.unique(lead[~equal]).tolist():
            best: dict[bytes, int] = {}
            for y in np.flatnonzero(lead == x).tolist():
                z = best.setdefault(text[i[y]:j[y]], y)
                later[y] = (d[y], s[y]) != (d[z], s[z])
    return merged(list(zip(d[later].tolist(), s[later].tolist(), (s[later] + window).tolist())))


def heavy(texts: DataFrame, window: int, group_bytes: int) -> tuple[frozenset[int], int]:
    """The minimisers whose packed strings exceed group_bytes, and the bytes of their windows one by one.

    There are at most as many of them as buckets. Equal strings count once for each batch.
    """

    def weigh(batches):
        for batch in batches:
            for _, _, buf, off in chunks(batch.column(0)):
                sizes: dict[int, list[int]] = {}
                for text, (words, least) in {x[3]: (x[2], x[4]) for x in super_windows(buf, off, window)}.items():
                    sum_ = sizes.setdefault(least, [0, 0])
                    sum_[0] += len(text)
                    sum_[1] += (len(text) + 1) * window * (words - window + 1) // words
                columns = [np.fromiter(sizes, np.uint64, len(sizes)).view(np.int64), *np.array(list(sizes.values()), np.int64).reshape(-1, 2).T]
                yield pa.record_batch([pa.array(x) for x in columns], ["least", "packed", "single"])

    found = texts.select("text").mapInArrow(weigh, "least long, packed long, single long").groupBy("least").agg(F.sum("packed").alias("packed"), F.sum("single").alias("single"))
    over = found.where(F.col("packed") > group_bytes).collect()
    return frozenset(r["least"] % (1 << 64) for r in over), sum(r["single"] for r in over)


def dealt(docs: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Packed strings by bucket (bucket, docs, starts, text), and stretches that a task found itself (text null)."""
    kept = only(docs, "doc_id", "text").where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    buckets = groups_for(kept, group_bytes) * EXPANSION
    hot, single = heavy(kept, window, group_bytes)
    hot_buckets = max(1, -(-single // group_bytes))

    def deal(batches):
        names = ["bucket", "docs", "starts", "stops", "text"]
        held: dict[bytes, tuple[int, int, int, int]] = {}
        gone: list[tuple[int, int, int]] = []
        size = 0

        def flush():
            by_bucket = defaultdict(list)
            for text, (d, s, _, least) in held.items():
                by_bucket[buckets + xxhash.xxh64_intdigest(text) % hot_buckets if least in hot else least % buckets].append((d, s, text))
            squeeze = zstandard.ZstdCompressor(1)
            rows = [(k, np.array([x[0] for x in v], np.int64).tobytes(), np.array([x[1] for x in v], np.int64).tobytes(), None, squeeze.compress(b"\n".join(x[2] for x in v))) for k, v in by_bucket.items()]
            by_doc = defaultdict(list)
            for d, i, j in merged(gone):
                by_doc[d % buckets].append((d, i, j))
            rows += [(k, *(np.array(c, np.int64).tobytes() for c in zip(*v)), None) for k, v in by_doc.items()]
            held.clear()
            gone.clear()
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names)

        def split(runs):
            for d, s, words, text, least in runs:
                if least not in hot:
                    yield d, s, words, text, least
                    continue
                parts = text.split(b" ")
                for i in range(words - window + 1):
                    yield d, s + i, window, b" ".join(parts[i : i + window]), least

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, _, buf, off in chunks(batch.column(1)):
                for d, s, words, text, least in split(super_windows(buf, off, window)):
                    d = int(ids[row + d])
                    old = held.get(text)
                    if old is None:
                        held[text] = (d, s, words, least)
                        size += len(text) + 150
                    elif (d, s) < old[:2]:
                        held[text] = (d, s, words, least)
                        gone.append((old[0], old[1], old[1] + words))
                    elif (d, s) != old[:2]:
                        gone.append((d, s, s + words))
                if size > HELD_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return kept.mapInArrow(deal, "bucket int, docs binary, starts binary, stops binary, text binary")


def repeats(docs: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, first, stop: stretches of words to remove; one document's stretches may overlap."""

    def settle(bucket: pa.Table) -> pa.Table:
        ids, starts, texts, spans = [], [], [], []
        for row in bucket.select(["docs", "starts", "stops", "text"]).to_pylist():
            d, s = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["starts"], np.int64)
            if row["text"] is None:
                spans.append(np.stack([d, s, np.frombuffer(row["stops"], np.int64)]))
            else:
                ids.append(d)
                starts.append(s)
                texts.append(zstandard.ZstdDecompressor().decompress(row["text"]))
        if ids:
            found = later_windows(np.concatenate(ids), np.concatenate(starts), b"\n".join(texts), window)
            spans.append(np.array(found, np.int64).reshape(-1, 3).T)
        out = np.concatenate(spans, axis=1)
        return pa.table([pa.array(x) for x in out], ["doc_id", "first", "stop"])

    return dealt(docs, window, group_bytes).groupBy("bucket").applyInArrow(settle, "doc_id long, first long, stop long")


def deduplicate(docs: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) for every row.

    A word goes if a window over it has the words of a window that starts earlier: in a smaller doc_id, or before it
    in the same document. A null or empty text has no words. Rows without doc_id keep all their words and do not count
    as earlier; rows that repeat a doc_id with one text are treated alike, and ids are otherwise taken as unique. An
    empty table gives no rows; other columns are ignored.
    """
    kept = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    groups = groups_for(kept, group_bytes)

    def finish(texts: pa.Table, spans: pa.Table) -> pa.Table:
        gone = defaultdict(list)
        for d, i, j in zip(spans["doc_id"].to_pylist(), spans["first"].to_pylist(), spans["stop"].to_pylist()):
            gone[d].append((i, j))
        out = []
        for d, text in zip(texts["doc_id"].to_pylist(), texts["text"].to_pylist()):
            words = (text or "").encode().split()
            n = len(words)
            if d is not None and d in gone:
                left = np.ones(n, bool)
                for i, j in gone[d]:
                    left[i:j] = False
                words = [words[i] for i in np.flatnonzero(left).tolist()]
            out.append((d, n, n - len(words), b" ".join(words).decode()))
        columns = zip(*out) if out else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept"])

    def group(df: DataFrame) -> DataFrame:
        key = F.pmod(F.xxhash64("doc_id"), F.lit(groups))
        return df.withColumn("grp", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(groups))).otherwise(key) if "text" in df.columns else key)

    left, right = group(kept), group(repeats(docs, window, group_bytes))
    return left.groupBy("grp").cogroup(right.groupBy("grp")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")
