"""Plain re-statements of the contracts, for small fixtures."""

import math
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import xxhash

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def low(text):
    return (text or "").translate(LOWER)


def digest(text):
    return sha256(text.encode()).hexdigest()


def remainder(doc_id, of):
    return None if doc_id is None else crc32(str(doc_id).encode()) % of


def secrets(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    rank = {"assign": 0, "access": 1, "hex": 2}
    found.sort(key=lambda x: (x[1], rank[x[0]]))
    return found, digest(",".join(f"{k}:{a}:{b}" for k, a, b in found))


def base_scores(docs):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of op1."""
    tokens = {i: [*SPACED.findall(low(t)), None] for i, (_, t) in enumerate(docs)}
    held = {i: remainder(d, 7) == 2 for i, (d, _) in enumerate(docs)}
    seen = Counter(t for i, row in tokens.items() if not held[i] for t in row)
    total = sum(seen.values())
    return [
        (d, held[i], len(tokens[i]), sum(seen[t] > 0 for t in tokens[i]), total, sum(math.log10((seen[t] + 1) / (total + len(seen) + 1)) for t in tokens[i]))
        for i, (d, _) in enumerate(docs)
    ]


def ppm(train, texts, order):
    """log10 probability of each text: escape by half a count of each distinct symbol, with exclusion."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]

    def padded(text):
        return b"\xfe" * order + low(text).encode() + b"\xff"

    for text in train:
        s = padded(text)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k][s[i - k : i]][s[i]] += 1
    out = []
    for text in texts:
        s, total = padded(text), 0.0
        for i in range(order, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                every = counts[k].get(s[i - k : i], {})
                left = {x: n for x, n in every.items() if x not in gone}
                if s[i] in left:
                    total += math.log10((left[s[i]] - 0.5) / sum(left.values()))
                    break
                if left:
                    total += math.log10(0.5 * len(left) / sum(left.values()))
                gone |= set(every)
            else:
                total -= math.log10(255 - len(gone))
        out.append(total)
    return out


def licenses(text):
    words = ALNUM.findall(low(text))
    places = [(i, PHRASES[p]) for p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def substrings(docs, window=20):
    words = [(d, SPACED.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1) if d is not None else ():
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for d, w in words:
        gone = {k for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i : i + window])] != (d, i) for k in range(i, i + window)}
        out.append((d, len(w), len(gone), digest(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def simhashes(docs):
    prints = []
    for _, text in docs:
        w = SPACED.findall(low(text))
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(docs)]


def contamination(docs, items, window=10):
    spans = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(low(text))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            spans[tuple(w[i : i + window])].add(item)
    sizes = {len(k) for k in spans}
    out = []
    for d, text in docs:
        w, hit, found = ALNUM.findall(low(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in spans:
                    hit |= set(range(i, i + n))
                    found |= spans[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), len(found), digest(",".join(sorted(map(str, found)))), bool(hit)))
    return out
