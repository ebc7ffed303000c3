"""Language-model scores by prediction by partial matching over bytes, with a word model as base.

The model is a trie of the byte contexts of all training texts, ORDER bytes deep, held as a distributed table of
(context, symbol) counts. A symbol's probability starts at its longest context; where that has not seen it, an escape
(method D: half a count of each distinct symbol seen) leads to the next shorter one, and symbols seen in the longer
context are excluded from the shorter one's counts. Below order 0 all symbols not yet excluded are equally likely.

Documents are dealt into blocks of a bounded size. A block sends its distinct words and contexts to buckets, which sum
them over all blocks; prices come back to the block, and every text is scored there.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, document_group, groups_for, only
from .text import LOWER, buffers, mix, pieces, span_hashes

ORDER = 5
#: Bytes that no UTF-8 text holds: before a text, and after it.
START, END = 0xFE, 0xFF
#: Symbols that can follow: all bytes but START.
ALPHABET = 255
BLOCK_BYTES = 16 << 20
SCHEMA = "kind int, bucket int, block int, keys binary, counts binary"
PRICES = "kind int, block int, keys binary, prices binary, total long, distinct long"


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(data)


def swell(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def contexts(buf: np.ndarray, off: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """A code for each symbol and the order bytes before it, and the bounds of each document's codes.

    A document's symbols are its bytes and END. The symbol is the code's last byte, the nearest context byte is next.
    """
    n = np.diff(off)
    docs = len(n)
    place = np.arange(docs) * (order + 1) + off[:-1]  # of each document's first START
    padded = np.full(len(buf) + docs * (order + 1), START, np.uint8)
    where = np.arange(len(buf)) + np.repeat(np.arange(docs) * (order + 1) + order, n)
    padded[where] = buf
    padded[place + order + n] = END
    wide = padded.astype(np.uint64)
    code = np.zeros(max(0, len(wide) - order), np.uint64)
    for k in range(order + 1):
        code = (code << np.uint64(8)) | wide[k : len(wide) - order + k]
    bounds = off + np.arange(docs + 1)
    real = np.arange(bounds[-1]) + np.repeat(np.arange(docs) * order, n + 1)
    return code[real], bounds


def price(codes: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log10 P(symbol | context) of distinct codes, all that share their nearest two context bytes.

    counts: how often each stands in training; pairs: 256 x 256 training counts of (nearest byte, symbol).
    """
    symbol, near = (codes & np.uint64(255)).astype(np.int64), ((codes >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
    single = pairs.sum(axis=0)
    seen_after = pairs > 0
    levels = []  # (count of the symbol, of the context, distinct symbols, what they count one order below)
    lower = pairs[near, symbol]
    for k in range(2, order + 1):
        whole, at = np.unique(codes & np.uint64((1 << (8 * (k + 1))) - 1), return_inverse=True)
        n = np.bincount(at, counts, len(whole)).astype(np.int64)
        below = np.zeros(len(whole), np.int64)
        below[at] = lower
        _, own = np.unique(whole >> np.uint64(8), return_inverse=True)
        total, distinct = np.bincount(own, n).astype(np.int64), np.bincount(own, n > 0).astype(np.int64)
        excluded = np.bincount(own, below * (n > 0)).astype(np.int64)
        levels.append((n[at], total[own][at], distinct[own][at], excluded[own][at]))
        lower = n[at]
    levels.insert(0, (pairs[near, symbol], pairs.sum(axis=1)[near], seen_after.sum(axis=1)[near], (seen_after @ single)[near]))
    zero = np.zeros(len(codes), np.int64)
    levels.insert(0, (single[symbol], zero + single.sum(), zero + (single > 0).sum(), zero))
    out, open_, gone, kinds = np.zeros(len(codes)), np.ones(len(codes), bool), zero, zero
    for n, total, distinct, below in reversed(levels):
        left, fresh = total - gone, distinct - kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            hit, escape = np.log10((n - 0.5) / left), np.log10(0.5 * fresh / left)
        found = open_ & (n > 0)
        out += np.where(found, hit, np.where(open_ & (fresh > 0), escape, 0.0))
        open_ &= ~found
        gone, kinds = below, distinct
    return out - np.where(open_, np.log10(np.maximum(1, ALPHABET - (single > 0).sum())), 0.0)


def _texts(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    buf, off = buffers(group["text"])
    return LOWER[buf], off


def gather(docs: DataFrame, buckets: int, order: int = ORDER) -> DataFrame:
    """For each block of docs (columns block, doc_id, text, train): its distinct words and contexts with training counts."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        number = block["block"][0].as_py()
        train = block["train"].to_numpy(zero_copy_only=False).astype(bool)
        buf, off = _texts(block)
        words: Counter = Counter()
        rest: set[bytes] = set()
        found = []
        for i, j in pieces(off):
            part, bounds = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            data = part.tobytes()
            for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                (words.update if train[i + d] else rest.update)(data[a:b].split())
            codes, own = contexts(part, bounds, order)
            unseen = np.repeat(~train[i:j], np.diff(own)).astype(np.uint64)
            codes, n = np.unique((codes << np.uint64(1)) | unseen, return_counts=True)
            found.append((codes >> np.uint64(1), np.where(codes & np.uint64(1), 0, n)))
        rows = []
        every = sorted(rest.union(words))
        if every:
            data = b"".join(every)
            ends = np.cumsum([len(w) for w in every])
            to = _word_buckets(np.frombuffer(data, np.uint8), ends, buckets)
            n = np.array([words[w] for w in every], np.int64)
            for k in np.unique(to).tolist():
                own = np.flatnonzero(to == k)
                rows.append((0, k, number, squeeze(b"\n".join([every[x] for x in own.tolist()])), squeeze(n[own].tobytes())))
        codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        n = np.bincount(at, np.concatenate([x for _, x in found])).astype(np.int64)
        to = (mix(codes) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        for own in np.split(by, np.flatnonzero(np.diff(to[by])) + 1):
            rows.append((1, int(to[own[0]]), number, squeeze(codes[own].tobytes()), squeeze(n[own].tobytes())))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["kind", "bucket", "block", "keys", "counts"])

    return docs.groupBy("block").applyInArrow(run, SCHEMA)


def _word_buckets(buf: np.ndarray, ends: np.ndarray, buckets: int) -> np.ndarray:
    out = []
    starts = np.concatenate([[0], ends[:-1]])
    for i in range(0, len(ends), 1 << 16):
        a, b = starts[i : i + (1 << 16)], ends[i : i + (1 << 16)]
        start = a[0]
        out.append(span_hashes(buf[start : b[-1]], a - start, b - start))
    return (np.concatenate(out) % np.uint64(buckets)).astype(np.int64)


def price_words(bucket: pa.Table) -> pa.Table:
    """log10(count + 1) of each block's words, and this bucket's share of all training tokens and distinct ones."""
    total: Counter = Counter()
    rows = []
    for row in bucket.select(["block", "keys", "counts"]).to_pylist():
        words, n = swell(row["keys"]).split(b"\n"), np.frombuffer(swell(row["counts"]), np.int64)
        rows.append((row["block"], row["keys"], words))
        for w, x in zip(words, n.tolist()):
            total[w] += x
    out = [(0, block, keys, squeeze(np.log10(np.array([total[w] for w in words]) + 1.0).tobytes()), 0, 0) for block, keys, words in rows]
    out.append((2, -1, None, None, sum(total.values()), sum(x > 0 for x in total.values())))
    return _prices(out)


def _prices(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["kind", "block", "keys", "prices", "total", "distinct"])


def sum_contexts(bucket: pa.Table) -> pa.Table:
    codes, counts = [], []
    for row in bucket.select(["keys", "counts"]).to_pylist():
        codes.append(np.frombuffer(swell(row["keys"]), np.uint64))
        counts.append(np.frombuffer(swell(row["counts"]), np.int64))
    codes, at = np.unique(np.concatenate(codes), return_inverse=True)
    n = np.bincount(at, np.concatenate(counts), len(codes)).astype(np.int64)
    return pa.table([bucket["bucket"].combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(codes), np.int32))), pa.array(codes.view(np.int64)), pa.array(n)], ["bucket", "code", "n"])


def return_contexts(blocks: pa.Table, priced: pa.Table) -> pa.Table:
    """Each block's contexts with their prices; both sides hold one bucket."""
    codes, prices = priced["code"].to_numpy().view(np.uint64), priced["price"].to_numpy()
    by = np.argsort(codes)
    codes, prices = codes[by], prices[by]
    rows = []
    for row in blocks.select(["block", "keys"]).to_pylist():
        own = prices[np.searchsorted(codes, np.frombuffer(swell(row["keys"]), np.uint64))]
        rows.append((1, row["block"], row["keys"], squeeze(own.tobytes()), 0, 0))
    return _prices(rows)


def score(docs: DataFrame, train, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every row: doc_id, n_tokens, n_known, train_tokens, base_score, score, and the bytes scored.

    train: a condition on docs; the models learn from the rows where it is true. Texts have A-Z lower-cased; a null
    text is empty and has one token, its end. score is log10 of the model's probability of the text's bytes and their
    end; base_score is the add-one word model's. Null ids are kept; repeated rows are each scored and each learned
    from; with nothing to learn from all symbols are equally likely; an empty table gives no rows; other columns are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    blocks = groups_for(rows, block_bytes)
    dealt = rows.withColumn("block", document_group(blocks))
    sent = cut(gather(dealt, blocks, order))
    words = cut(sent.where("kind = 0").groupBy("bucket").applyInArrow(price_words, PRICES))
    known = words.where("kind = 2").agg(F.sum("total"), F.sum("distinct")).first()
    ends = rows.where("train").count()
    total, distinct = (known[0] or 0) + ends, (known[1] or 0) + (ends > 0)

    found = cut(sent.where("kind = 1").groupBy("bucket").applyInArrow(sum_contexts, "bucket int, code long, n long"))
    near = found.groupBy(F.col("code").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("n").alias("n")).where("n > 0").collect()
    table = np.zeros((256, 256), np.int64)
    for pair, n in near:
        table[pair >> 8, pair & 255] = n
    pairs = rows.sparkSession.sparkContext.broadcast(table)

    def price_group(group: pa.Table) -> pa.Table:
        codes = group["code"].to_numpy().view(np.uint64)
        return pa.table([group["bucket"], group["code"], pa.array(price(codes, group["n"].to_numpy(), pairs.value, order))], ["bucket", "code", "price"])

    nearest = F.pmod(F.xxhash64(F.shiftright("code", 8).bitwiseAND(0xFFFF)), F.lit(blocks))
    priced = found.withColumn("near", nearest).groupBy("near").applyInArrow(price_group, "bucket int, code long, price double")
    codes = sent.where("kind = 1").groupBy("bucket").cogroup(priced.groupBy("bucket")).applyInArrow(return_contexts, PRICES)
    back = words.where("kind = 0").union(codes)

    def finish(texts: pa.Table, prices: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        value: dict[bytes, float] = {}
        codes, costs = [], []
        for row in prices.select(["kind", "keys", "prices"]).to_pylist():
            numbers = np.frombuffer(swell(row["prices"]), np.float64)
            if row["kind"]:
                codes.append(np.frombuffer(swell(row["keys"]), np.uint64))
                costs.append(numbers)
            else:
                value.update(zip(swell(row["keys"]).split(b"\n"), numbers.tolist()))
        codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        costs = np.concatenate(costs) if costs else np.zeros(0)
        by = np.argsort(codes)
        codes, costs = codes[by], costs[by]
        buf, off = _texts(texts)
        out = []
        for i, j in pieces(off):
            part, bounds = buf[off[i] : off[j]], off[i : j + 1] - off[i]
            now, own = contexts(part, bounds, order)
            logs = np.add.reduceat(costs[np.searchsorted(codes, now)], own[:-1])
            data = part.tobytes()
            for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                got = list(map(value.__getitem__, data[a:b].split()))
                out.append((len(got) + 1, len(got) - got.count(0.0), sum(got), logs[d], b - a))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)]
        return pa.table([texts["doc_id"], *columns], ["doc_id", "n_tokens", "n_words_known", "words", "score", "n_bytes"])

    scored = dealt.select("block", "doc_id", "text").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(
        finish, "doc_id long, n_tokens long, n_words_known long, words double, score double, n_bytes long"
    )
    end = float(np.log10(ends + 1.0))
    return scored.select(
        "doc_id",
        "n_tokens",
        (F.col("n_words_known") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("words") + end - F.col("n_tokens") * float(np.log10(total + distinct + 1.0))).alias("base_score"),
        "score",
        "n_bytes",
    )
