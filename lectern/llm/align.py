"""Alignment of two tokenizers' tokens by the bytes that they own.

A text is cut where a space follows a character that is no white space: neither tokenizer joins anything across such a
place, so each distinct segment is aligned once. In a segment every byte is given its owner among the tokens of A and
of B; where both owners change at once lies a cut, and tokens between two cuts form a group whose tokens are linked.
Documents stay in the blocks in which they were read; only a block's distinct pairs travel to be counted over the
corpus, and their counts travel back to the block.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, stored
from .text import chunks, span_hashes

#: Text bytes of a block.
BLOCK = 4 << 20
#: Longer segments are told apart by a stronger hash and encoded one by one.
LONG_SEGMENT = 64
#: Segments encoded in one text.
TOGETHER = 512
#: Links of a group beyond which it lists its distinct pairs.
LONG_GROUP = 4096

_codec = pa.Codec("zstd", 1)
_loaded: dict[int, tuple] = {}


def _alphabet() -> dict[str, int]:
    """The letters of byte-level tokens: printable Latin-1 stands for itself, all else for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Pair:
    """Both tokenizers with the bytes of each of their tokens."""

    def __init__(self, definition: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(definition)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.space = self.b.piece_to_id("▁")
        letters = _alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in json.loads(definition)["model"]["vocab"].items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in known], np.int64) for known in (self.bytes_a, self.bytes_b))
        self.names = [f"{i}{mark}" for known, end in ((self.bytes_a, "|"), (self.bytes_b, ";")) for i in range(len(known)) for mark in (",", end)]
        self.name_sizes = np.array([len(x) for x in self.names], np.int64)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for texts that start with a space, which B adds by itself."""
        first = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # a lone space is the last of a longer text: B, which adds none to an empty text, has one token for it there
        return list(zip(first, [ids or [self.space] for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]))


def owners(ids: list[int], known: list[bytes]) -> np.ndarray:
    """For each byte, the place of the token that owns it."""
    return np.repeat(np.arange(len(ids)), [len(known[i]) for i in ids])


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of A and B tokens that share bytes: the consecutive distinct pairs of owners."""
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return np.stack([a[fresh], b[fresh]], 1)


def cuts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes at which both owners change at once; the first byte is one."""
    return np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) & (b[1:] != b[:-1])) + 1]) if len(a) else np.zeros(0, np.int64)


def encode_apart(words: list[bytes], both: Pair) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, good, ids of A, ids of B): the ids of all good words one after another in the order that they were encoded.

    Many words are encoded in one text, except those that end with white space. A word is good if the bytes of both
    sides' tokens are its own.
    """
    good, order, first, second = np.zeros(len(words), bool), [], [], []
    plain = [i for i, w in enumerate(words) if len(w) <= LONG_SEGMENT and w[-1] > 32 and (w[-1] < 128 or w.decode()[-1:].strip())]
    alone = sorted(set(range(len(words))) - set(plain))

    def take(some: list[list[int]]) -> list[int]:
        left = []
        texts = [b"".join([words[i] for i in one]) for one in some]
        for one, text, (a, b) in zip(some, texts, both.encode([t.decode() for t in texts])):
            fits = b"".join([both.bytes_a[i] for i in a]) == text == b"".join([both.bytes_b[i] for i in b])
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            if fits and len(one) > 1:
                ends = np.cumsum([len(words[i]) for i in one])
                fits = np.isin(ends, np.cumsum(both.sizes_a[a])).all() and np.isin(ends, np.cumsum(both.sizes_b[b])).all()
            if fits:
                good[one] = True
                order.extend(one)
                first.append(a)
                second.append(b)
            elif len(one) > 1:
                left += one
        return left

    runs = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
    for i in range(0, len(runs), 16):
        alone += take(runs[i : i + 16])
    for i in range(0, len(alone), TOGETHER):
        take([[k] for k in alone[i : i + TOGETHER]])
    none = [np.zeros(0, np.int64)]
    return np.array(order, np.int64), good, np.concatenate(first or none), np.concatenate(second or none)


class Segments:
    """The alignment of distinct segments: sums, written groups and linked pairs of each."""

    def __init__(self, words: list[bytes], both: Pair):
        order, self.good, a, b = encode_apart(words, both)
        n = len(words)
        own_a, own_b = np.repeat(np.arange(len(a)), both.sizes_a[a]), np.repeat(np.arange(len(b)), both.sizes_b[b])
        at = cuts(own_a, own_b)
        sizes = np.array([len(words[i]) for i in order], np.int64)
        begins = np.cumsum(sizes) - sizes
        word = order[np.searchsorted(begins, at, "right") - 1] if len(at) else np.zeros(0, np.int64)
        from_a, from_b = own_a[at], own_b[at]
        many_a, many_b = np.diff(np.append(from_a, len(a))), np.diff(np.append(from_b, len(b)))
        self.sums = np.stack([np.bincount(word, weights=w, minlength=n).astype(np.int64) for w in (many_a, many_b, np.ones(len(at)), many_a * many_b)], 1)
        self.written = self._write(a, b, from_a, from_b, many_a, many_b, word, n, both)
        self.many, self.keys, self.times = self._pairs(a, b, from_a, from_b, many_a, many_b, word, n)

    @staticmethod
    def _write(a, b, from_a, from_b, many_a, many_b, word, n, both) -> list[str]:
        """Each segment's groups as text: every id is followed by a comma, or by the mark that ends its side of the group."""
        size = many_a + many_b
        start = np.cumsum(size) - size
        codes = np.zeros(int(size.sum()), np.int64)
        group = np.repeat(np.arange(len(size)), many_a)
        codes[np.arange(len(a)) - from_a[group] + start[group]] = 2 * a
        group = np.repeat(np.arange(len(size)), many_b)
        codes[np.arange(len(b)) - from_b[group] + (start + many_a)[group]] = 2 * (b + len(both.bytes_a))
        codes[start + many_a - 1] += 1
        codes[start + size - 1] += 1
        text = "".join([both.names[c] for c in codes.tolist()])
        length = np.add.reduceat(both.name_sizes[codes], start) if len(start) else np.zeros(0, np.int64)
        ends = np.cumsum(length)
        out = [""] * n
        turn = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
        for w, i, j in zip(word[turn].tolist(), (ends - length)[turn].tolist(), ends[np.append(turn[1:], len(word)) - 1].tolist()):
            out[w] = text[i:j]
        return out

    @staticmethod
    def _pairs(a, b, from_a, from_b, many_a, many_b, word, n):
        """(number of entries of each segment, linked pairs, how often each is linked); a long group lists each distinct pair once."""
        links = many_a * many_b
        long = np.flatnonzero(links > LONG_GROUP)
        short = np.where(links > LONG_GROUP, 0, links)
        group = np.repeat(np.arange(len(links)), short)
        k = np.arange(int(short.sum())) - np.repeat(np.cumsum(short) - short, short)
        keys = a[from_a[group] + k // many_b[group]] << 32 | b[from_b[group] + k % many_b[group]]
        words, times = [word[group]], [np.ones(len(keys), np.int64)]
        keys = [keys]
        for g in long.tolist():
            x, p = np.unique(a[from_a[g] : from_a[g] + many_a[g]], return_counts=True)
            y, q = np.unique(b[from_b[g] : from_b[g] + many_b[g]], return_counts=True)
            keys.append((x[:, None] << 32 | y[None]).ravel())
            times.append((p[:, None] * q[None]).ravel())
            words.append(np.full(len(keys[-1]), word[g]))
        words, keys, times = np.concatenate(words), np.concatenate(keys), np.concatenate(times)
        order = np.argsort(words, kind="stable")
        return np.bincount(words, minlength=n), keys[order], times[order]


def segments(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a space before each text, starts of segments, bounds of each text's among them)."""
    n = len(off) - 1
    text = np.zeros(len(buf) + n, np.uint8)
    begins = off[:-1] + np.arange(n)
    inside = np.ones(len(text), bool)
    inside[begins] = False
    text[inside], text[begins] = buf, 32
    one, two, three = (np.concatenate([np.zeros(k, np.uint8), text[:-k]]) if len(text) >= k else np.zeros(len(text), np.uint8) for k in (1, 2, 3))
    # no cut after a control, nor after white space of two or three bytes
    white = (two == 0xC2) & ((one == 0xA0) | (one == 0x85)) | (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80) | (three == 0xE1) & (two == 0x9A)
    start = (text == 32) & (one > 32) & (one != 127) & ~(white & (one >= 128))
    start[begins] = True
    at = np.flatnonzero(start)
    return text, at, np.searchsorted(at, np.append(begins, len(text)))


def align_block(buf: np.ndarray, off: np.ndarray, both: Pair) -> dict:
    """The documents of a block: their sums, their segments, and the block's pairs with the number of documents that hold each."""
    text, at, bounds = segments(buf, off)
    ends = np.append(at[1:], len(text))
    data = text.tobytes()
    h = span_hashes(text, at, ends)
    for i in np.flatnonzero(ends - at > LONG_SEGMENT).tolist():
        h[i] = xxhash.xxh64_intdigest(data[at[i] : ends[i]])
    del text
    _, first, own = np.unique(h, return_index=True, return_inverse=True)
    found = Segments([data[i:j] for i, j in zip(at[first].tolist(), ends[first].tolist())], both)

    n, kinds = len(off) - 1, max(1, len(found.good))
    doc = np.repeat(np.arange(n), np.diff(bounds))
    bad = (np.bincount(doc, weights=~found.good[own], minlength=n) > 0) | (off[1:] == off[:-1])
    totals = np.stack([np.diff(np.concatenate([[0], np.cumsum(found.sums[own, k])])[bounds]) for k in range(4)], 1)
    totals[bad] = 0
    place = own.tolist()
    # a text's groups end with the mark of the last one, which is not written
    digests = ["" if bad[d] else hashlib.sha256("".join([found.written[i] for i in place[bounds[d] : bounds[d + 1]]])[:-1].encode()).hexdigest() for d in range(n)]
    keep = ~bad[doc]
    doc, own = doc[keep], own[keep]
    names, pair = np.unique(found.keys, return_inverse=True)
    # the segments that each document holds, then its distinct pairs
    held = np.unique(doc * kinds + own)
    who, what = held // kinds, held % kinds
    size = found.many[what]
    each = np.repeat((np.cumsum(found.many) - found.many)[what] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    once = np.unique(np.repeat(who, size) * max(1, len(names)) + pair[each])
    docs = np.bincount(once % max(1, len(names)), minlength=len(names))
    there = docs > 0
    # pairs of left-out texts alone point past the block's pairs
    number = np.where(there, np.cumsum(there) - 1, int(there.sum()))
    return {
        "totals": totals, "digests": digests, "keys": names[there], "docs": docs[there],
        "size": np.bincount(doc, minlength=n), "own": own, "many": found.many, "pair": number[pair], "times": found.times,
    }


def _packed(x: np.ndarray, kind: str) -> bytes:
    return len(x).to_bytes(8, "little") + _codec.compress(np.ascontiguousarray(x, kind).tobytes(), asbytes=True)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(_codec.decompress(data[8:], n * np.dtype(kind).itemsize, asbytes=True), kind) if n else np.zeros(0, kind)


_PACKED = {"size": "<i4", "own": "<i4", "many": "<i4", "pair": "<i4", "times": "<i8"}
_SUMS = ["n_a", "n_b", "n_groups", "n_links"]


def _both(definition: str, model: bytes) -> Pair:
    key = hash((definition, model))
    if key not in _loaded:
        _loaded[key] = Pair(definition, model)
    return _loaded[key]


def align(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A reads a space and the text, B the text. A text that is null or empty, or whose tokens' bytes of either side are
    not that space and text, has no tokens: zeros, and an empty string. Repeated rows and rows without doc_id are
    documents of their own; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    with open(byte_path, encoding="utf-8") as f, open(piece_path, "rb") as g:
        sent = spark.sparkContext.broadcast((f.read(), g.read()))

    def blocks(batches):
        both = _both(*sent.value)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, buf, off in chunks(batch.column("text"), BLOCK):
                x = align_block(buf, off, both)
                columns = [[number], [batch.column("doc_id").slice(i, j - i).to_pylist()], [x["digests"]], [x["keys"]], [x["docs"]]]
                columns += [[x["totals"][:, k]] for k in range(4)] + [[_packed(x[name], kind)] for name, kind in _PACKED.items()]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, layout)], layout)
                number += 1

    lists = pa.list_(pa.int64())
    layout = pa.schema([("block", pa.int64()), ("ids", lists), ("digests", pa.list_(pa.string())), ("keys", lists), ("docs", lists), *[(s, lists) for s in _SUMS], *[(name, pa.binary()) for name in _PACKED]])
    kinds = "block long, ids array<long>, digests array<string>, keys array<long>, docs array<long>, " + ", ".join(f"{s} array<long>" for s in _SUMS) + ", " + ", ".join(f"{name} binary" for name in _PACKED)
    found = stored(only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(blocks, kinds))

    counts = found.select(F.explode(F.arrays_zip("keys", "docs")).alias("x")).groupBy(F.col("x.keys").alias("pair")).agg(F.sum("x.docs").alias("n"))
    # a first id has at most as many pairs as B has pieces
    counts = counts.withColumn("top", F.col("n") == F.max("n").over(Window.partitionBy(F.shiftright("pair", 32))))
    wanted = found.select(F.col("block").alias("of"), F.explode("keys").alias("pair")).join(counts, "pair").select("of", "pair", "n", "top")

    def priced(block: pa.Table, pairs: pa.Table) -> pa.Table:
        block = block.to_pylist()[0]
        order = np.argsort(pairs["pair"].to_numpy())
        n, top = np.append(pairs["n"].to_numpy()[order], 0), np.append(pairs["top"].to_numpy(zero_copy_only=False)[order], False)
        size, own, many, pair, times = (_unpacked(block[name], kind) for name, kind in _PACKED.items())
        worth = times * n[pair], times * top[pair]
        ends, docs_at = np.concatenate([[0], np.cumsum(many)]), np.concatenate([[0], np.cumsum(size)])
        out = []
        for w in worth:
            of_segment = np.diff(np.concatenate([[0], np.cumsum(w)])[ends])
            out.append(np.diff(np.concatenate([[0], np.cumsum(of_segment[own])])[docs_at]))
        columns = [pa.array(block["ids"], pa.int64()), *[pa.array(block[s], pa.int64()) for s in _SUMS], pa.array(out[1], pa.int64()), pa.array(out[0], pa.int64()), pa.array(block["digests"], pa.string())]
        return pa.table(columns, ["doc_id", *_SUMS, "n_best", "count_sum", "groups_sha256"])

    payload = found.select("block", "ids", "digests", *_SUMS, *_PACKED)
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return payload.groupBy("block").cogroup(wanted.groupBy("of")).applyInArrow(priced, schema)
