"""Packing of token sequences into fixed windows, best-fit decreasing.

Documents are dealt into groups of a bounded number of tokens. In a group, a document longer than a window is cut into
full windows first; the rests go, longest first, each into the open window with the least room that still takes it,
found by a segment tree over the remaining capacity. Windows that stay open wide at the end are emptied and filled
again as one stream cut at the window's length, whose last part falls into power-of-two lengths that need no padding.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GROUP_BYTES, document_group, groups_for, only
from .text import LOWER, NOT_SPACE, chunks, span_hashes, word_spans

WINDOW = 2048
END_ID = 1
#: Padding up to which a window is left as it is.
SLACK = 16
#: Words whose ids a task keeps at hand; they go when the task ends.
KEPT_WORDS = 300_000
#: Longer words are told apart by a stronger hash and encoded one by one.
LONG_WORD = 64
#: Stands between words that are encoded together; it is one token, and words that hold it are encoded alone.
MARK = b"~"

#: Bytes by what the tokenizer splits at: white space, letters (and all of other alphabets), digits, the rest.
_KIND = np.full(256, 3, np.uint8)
_KIND[~NOT_SPACE] = 0
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2
_NEVER = np.int64(1) << 40

_tokenizers: dict[int, tuple] = {}


class Merges:
    """The merge rules of a byte-pair tokenizer as arrays: the ids of single bytes, and a hash table of pairs."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        # the byte alphabet: printable Latin-1 stands for itself, all else for letters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[letter[b] + model["end_of_word_suffix"]] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pair = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.keys, self.ranks = np.full(1 << 18, -1, np.int64), np.full(1 << 18, _NEVER)
        left = np.arange(len(pair))
        place = self._slot(pair)
        while len(left):
            here, one = np.unique(place, return_index=True)
            free = self.keys[here] < 0
            self.keys[here[free]], self.ranks[here[free]] = pair[left[one[free]]], left[one[free]]
            rest = np.ones(len(left), bool)
            rest[one[free]] = False
            left, place = left[rest], (place[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _NEVER where no rule joins it."""
        pair = (left << 20) | right
        place = self._slot(pair)
        found = self.keys[place]
        out = np.where(found == pair, self.ranks[place], _NEVER)
        at = np.flatnonzero((found != pair) & (found >= 0))
        while len(at):
            place[at] = (place[at] + 1) & (len(self.keys) - 1)
            found = self.keys[place[at]]
            out[at] = np.where(found == pair[at], self.ranks[place[at]], _NEVER)
            at = at[(found != pair[at]) & (found >= 0)]
        return out

    def encode(self, flat: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The ids of words that stand one after another in flat: in all of them at once the best pair is merged first."""
        symbol = self.inner[flat]
        symbol[np.cumsum(size) - 1] = self.final[flat[np.cumsum(size) - 1]]
        word, size = np.repeat(np.arange(len(size)), size), size.copy()
        alive = np.arange(len(size))
        rank = np.full(len(symbol), _NEVER)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.rank(symbol[inside], symbol[inside + 1])
        done = []
        while len(alive):
            n = size[alive]
            least = np.minimum.reduceat(rank, np.cumsum(n) - n)
            each = np.repeat(least, n)
            over = each == _NEVER
            if over.any():
                done.append((word[over], symbol[over]))
                word, symbol, rank, each, alive = word[~over], symbol[~over], rank[~over], each[~over], alive[least < _NEVER]
                if not len(alive):
                    break
            at = np.flatnonzero(rank == each)
            at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            symbol[at] = self.made[rank[at]]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            word, symbol, rank = word[stay], symbol[stay], rank[stay]
            size[alive] -= 1
            at -= np.arange(len(at))
            rank[at] = _NEVER
            after = at[(at + 1 < len(word)) & (word[np.minimum(at + 1, len(word) - 1)] == word[at])]
            rank[after] = self.rank(symbol[after], symbol[after + 1])
            before = at[(at > 0) & (word[at - 1] == word[at])]
            rank[before - 1] = self.rank(symbol[before - 1], symbol[before])
        word, symbol = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        data = symbol[np.argsort(word, kind="stable")].astype("<u2").tobytes()
        ends = (2 * np.cumsum(size)).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]


def _tokenizer(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    key = hash(definition)
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer.from_str(definition), Merges(json.loads(definition)["model"])
    return _tokenizers[key]


def _encode_words(words: list[bytes], tokenizer) -> list[bytes]:
    """The ids of each word by the tokenizer itself: those without MARK many at once, cut at its id."""
    if any(MARK in w for w in words):
        return [array("H", tokenizer.encode(w.decode(), add_special_tokens=False).ids).tobytes() for w in words]
    mark = tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
    out = []
    between = b" " + MARK + b" "
    for e in tokenizer.encode_batch_fast([between.join(words[i : i + 512]).decode() for i in range(0, len(words), 512)], add_special_tokens=False):
        ids = np.array(e.ids, "<u2")
        cuts = np.flatnonzero(ids == mark[0]).tolist()
        data = ids.tobytes()
        out += [data[2 * a : 2 * b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)])]
    return out


def _parts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and the starts, the ends and the plainness of the parts that the tokenizer never joins.

    In a plain word (ASCII and Latin-1 letters, digits and ASCII punctuation but the apostrophe) parts are runs of
    letters, single digits and runs of punctuation. Any other word is one part. Special tokens are case-sensitive, so
    a text that may hold one keeps its case here.
    """
    low = LOWER[buf]
    special = np.zeros(len(buf), bool)
    special[:-1] = (buf[:-1] == 60) & (buf[1:] == 124)
    if special.any():
        for d in np.unique(np.searchsorted(off, np.flatnonzero(special), "right") - 1).tolist():
            low[off[d] : off[d + 1]] = buf[off[d] : off[d + 1]]
    odd = special | (low == 39)
    high = low >= 128
    if high.any():
        lead = np.zeros(len(low), bool)
        lead[:-1] = (low[:-1] == 0xC3) & (low[1:] != 0x97) & (low[1:] != 0xB7)
        follow = np.zeros(len(low), bool)
        follow[1:] = lead[:-1]
        odd |= high & ~lead & ~follow
        low = np.where(follow & (low < 0x9F), low + np.uint8(32), low)
    kind = _KIND[low]
    begin = kind > 0
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    first = off[:-1][off[:-1] < off[1:]]
    begin[first] = kind[first] > 0
    odds = np.concatenate([[0], np.cumsum(odd, dtype=np.int32)])
    if odds[-1]:
        a, b, _ = word_spans(low, off, NOT_SPACE)
        whole = odds[b] > odds[a]
        cover = np.zeros(len(low) + 1, np.int32)
        np.add.at(cover, a[whole] + 1, 1)
        np.add.at(cover, b[whole], -1)
        begin &= np.cumsum(cover)[:-1] == 0
    stop = kind > 0
    stop[:-1] &= begin[1:] | (kind[1:] == 0)
    last = off[1:][off[:-1] < off[1:]] - 1
    stop[last] = kind[last] > 0
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return low, a, b, (odds[b] == odds[a]) & (kind[a] == 1)


def encode(buf: np.ndarray, off: np.ndarray, definition: str, known: dict[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit ids of all texts and the bounds of each text's; known: ids of word parts met before, which grows.

    The tokenizer lower-cases and drops white space, and no token spans it, so each distinct part is encoded once.
    """
    tokenizer, merges = _tokenizer(definition)
    low, a, b, plain = _parts(buf, off)
    data = low.tobytes()
    h = span_hashes(low, a, b)
    for i in np.flatnonzero(b - a > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(data[a[i] : b[i]])
    _, first, own = np.unique(h, return_index=True, return_inverse=True)
    words = [data[i:j] for i, j in zip(a[first].tolist(), b[first].tolist())]
    if len(known) > KEPT_WORDS:
        known.clear()
    new = np.array([w not in known for w in words], bool)
    quick = plain[first] & (b[first] - a[first] <= LONG_WORD)
    some = [words[i] for i in np.flatnonzero(new & quick).tolist()]
    if some:
        known.update(zip(some, merges.encode(LOWER[np.frombuffer(b"".join(some), np.uint8)], np.array([len(w) for w in some]))))
    slow = [words[i] for i in np.flatnonzero(new & ~quick).tolist()]
    for some in ([w for w in slow if MARK not in w], [w for w in slow if MARK in w]):
        known.update(zip(some, _encode_words(some, tokenizer)))
    ids = [known[w] for w in words]
    size = np.array([len(x) for x in ids], np.int64) // 2
    begin, n = np.cumsum(size) - size, size[own]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(n) else 0) + np.repeat(begin[own] - (ends - n), n)
    return np.frombuffer(b"".join(ids), "<u2")[at], np.concatenate([[0], ends])[np.searchsorted(a, off)]


class RoomTree:
    """Open windows by remaining capacity: a segment tree whose leaves are capacities and hold stacks of windows."""

    def __init__(self, capacity: int):
        self.base = 1 << (capacity + 1).bit_length()
        self.full = bytearray(2 * self.base)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        i = self.base + room
        while i and not self.full[i]:
            self.full[i] = 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The window with the smallest room of at least least, and that room."""
        full, i = self.full, self.base + least
        if not full[i]:
            while not (i & 1 == 0 and full[i + 1]):
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.base:
                i = 2 * i if full[2 * i] else 2 * i + 1
        room = i - self.base
        window = self.stacks[room].pop()
        if not self.stacks[room]:
            full[i] = 0
            while (i := i >> 1) and not (full[2 * i] or full[2 * i + 1]):
                full[i] = 0
        return room, window


def plan(lengths: list[int], capacity: int = WINDOW, slack: int = SLACK) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length) in order; each token lies in one piece."""
    windows: list[list[tuple[int, int, int]]] = []
    rests = []
    for d, n in enumerate(lengths):
        whole = n - n % capacity
        windows += [[(d, s, capacity)] for s in range(0, whole, capacity)]
        if n > whole:
            rests.append((d, whole, n - whole))
    rests.sort(key=lambda x: (-x[2], x[0]))
    tree, open_room = RoomTree(capacity), {}
    for piece in rests:
        found = tree.take(piece[2])
        if found is None:
            windows.append([])
            found = capacity, len(windows) - 1
        room, w = found
        windows[w].append(piece)
        if room > piece[2]:
            tree.add(room - piece[2], w)
            open_room[w] = room - piece[2]
        else:
            open_room.pop(w, None)
    wide = [w for w, room in sorted(open_room.items()) if room > slack]
    stream = [piece for w in wide for piece in windows[w]]
    windows = [x for w, x in enumerate(windows) if w not in set(wide)]
    left = sum(n for _, _, n in stream)
    sizes = [capacity] * (left // capacity) + [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if (left % capacity) >> k & 1]
    stream.reverse()
    for size in sizes:
        now = []
        while size:
            d, s, n = stream.pop()
            if n > size:
                stream.append((d, s + size, n - size))
                n = size
            now.append((d, s, n))
            size -= n
        windows.append(now)
    return windows


def pack(docs: DataFrame, tokenizer_path: str, with_ids: bool = True, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids.

    A document's ids are its tokens and END_ID; a null text has no tokens before it. Sequences hold at most WINDOW
    tokens. Rows with a null doc_id and repeated rows are packed like any other; an empty table gives no rows; other
    columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def tokenize(batches):
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for i, j, buf, off in chunks(batch.column("text")):
                ids, bounds = encode(buf, off, definition.value, known)
                packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.record_batch([batch.column("grp").slice(i, j - i), batch.column("doc_id").slice(i, j - i), packed], ["grp", "doc_id", "ids"])

    def windows(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rows = sorted(zip(group["doc_id"].to_pylist(), group["ids"].to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        tokens = [np.append(np.frombuffer(x, "<u2").astype("<u4"), np.uint32(END_ID)) for _, x in rows]
        first = (group["grp"][0].as_py() if len(group) else 0) << 32
        out: list[tuple] = []
        ids = []
        for w, pieces in enumerate(plan([len(t) for t in tokens])):
            offset = 0
            for d, s, n in pieces:
                part = tokens[d][s : s + n]
                out.append((rows[d][0], s, n, zlib.crc32(part.tobytes()), len(tokens[d]), first + w, offset))
                offset += n
                if with_ids:
                    ids.append(part.view("<i4"))
        columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))))
            names.append("ids")
        return pa.table(columns, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    kept = only(docs, "doc_id", "text")
    dealt = kept.select(document_group(groups_for(kept, group_bytes)).alias("grp"), F.col("doc_id").cast("long"), "text")
    return dealt.mapInArrow(tokenize, "grp int, doc_id long, ids binary").groupBy("grp").applyInArrow(windows, schema)
