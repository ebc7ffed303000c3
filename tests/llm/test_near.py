"""The near-copy stage of the pipeline against brute force over word shingles and the links of op5."""

import random

import brute
import numpy as np
import pytest
import zstandard

import corpus_pipeline
from lectern.llm import near


def varied(words, rng, share):
    """The words with a stretch replaced, so that about a share of the shingles differ."""
    n = max(1, round(share * len(words)) - 4)
    at = rng.randrange(len(words) - n)
    return words[:at] + [f"n{rng.random()}" for _ in range(n)] + words[at + n :]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_copies_at_a_similarity_of_0_8_and_more(spark):
    rng, texts = random.Random(7), []
    for size in (45, 60, 90, 150, 400, 1500) * 5:
        words = [f"w{rng.randrange(5000)}" for _ in range(size)]
        texts += [" ".join(varied(words, rng, s)) for s in (0.0, 0.03, 0.06, 0.09, 0.11, 0.13, 0.2)]
        texts.append(" ".join(words).upper())
    texts += ["", None, " \n", "one two", "ONE two", "one two three"]
    sets = [shingles(t or "") for t in texts]
    root, at_least, between = list(range(len(texts))), 0, 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            at_least += 0.8 <= both / max(1, either) < 0.95
            between += 0.6 <= both / max(1, either) < 0.8
            if both >= 0.8 * either:
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert at_least > 100 and between > 100
    for i, _, c in brute.simhashes(list(enumerate(texts))):
        root[max(find(i), find(c))] = min(find(i), find(c))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, texts[3], 1)], "doc_id long, text string, node int")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    want = sorted({find(i) for i in range(len(texts))})
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == want
    assert got.where("doc_id is null").count() == 1


def components(links, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def group_just_below(n, rng):
    """Texts of one ancestor, most pairs a little below 0.8, some above; and unlike ones among them."""
    words = [f"w{i}" for i in range(150)]
    out = []
    for i in range(n):
        own = list(words)
        for _ in range(rng.choice([1, 2, 3, 3, 3])):
            own[rng.randrange(150)] = f"x{rng.random()}"
        out.append(" ".join(own if i % 10 else [f"y{rng.random()}" for _ in range(40)]))
    return out


def test_shared_counts_and_forest():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 5), (40, 30), (60, 4000), (0, 1)):
        sets = [np.unique(rng.integers(0, kinds, rng.integers(0, 60)).astype(np.uint64)) for _ in range(n)]
        counts = near.shared_counts(sets)
        assert all(counts[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(n) for j in range(n) if i != j)
        every = [(i, j) for i in range(n) for j in range(i + 1, n) if len(sets[i]) + len(sets[j]) and counts[i, j] / (len(sets[i]) + len(sets[j]) - counts[i, j]) >= 0.3]
        links = near.forest(sets, list(range(n)), np.zeros(n, np.int64), 0.3)
        assert set(links) <= set(every) and components(links, n) == components(every, n) and len(links) <= max(0, n - 1)


@pytest.mark.parametrize("block", [512, 16])
def test_a_group_hands_on_a_forest_never_its_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    texts = group_just_below(120, random.Random(3))
    sets = [shingles(t) for t in texts]
    every = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    below = sum(0.6 <= len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.8 for j in range(len(texts)) for i in range(j))
    assert len(every) > 100 and below > 2000
    packed = spark.createDataFrame([(i, zstandard.compress(t.encode())) for i, t in enumerate(texts)], "node long, packed binary")
    members = spark.createDataFrame([(k, i, i) for k in (5, 6) for i in range(len(texts)) if k == 5 or i % 2], "key long, node long, root long")
    links = [tuple(r) for r in near.similar_inside(members, packed, near.SHINGLE, near.SIMILARITY).collect()]
    assert set(links) <= set(every) and components(links, len(texts)) == components(every, len(texts))
    blocks = -(-len(texts) // block)
    assert len(links) <= 2 * len(texts) * blocks
    assert near.similar_inside(members.where("false"), packed, 5, 0.8).count() == 0
