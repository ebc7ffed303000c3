"""Substring dedup where one long word is the minimiser of every window."""

import random
from collections import Counter

import brute
import zstandard

from lectern.llm import substring

BOUND = 20_000


def test_windows_of_a_hot_minimiser_are_dealt_out(spark):
    rng, texts = random.Random(5), []
    for _ in range(120):
        words = [f"w{rng.randrange(900)}" for _ in range(200)]
        words[::12] = ["extraordinarily"] * len(words[::12])
        texts.append(" ".join(words + (texts[rng.randrange(len(texts))].split()[40:90] if texts else [])))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = Counter()
    for r in substring.dealt(docs, group_bytes=BOUND).where("text is not null").collect():
        held[r["bucket"]] += len(zstandard.ZstdDecompressor().decompress(r["text"]))
    assert sum(held.values()) > 10 * BOUND and max(held.values()) < 2 * BOUND
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], brute.digest(r["kept"])) for r in substring.deduplicate(docs, group_bytes=BOUND).collect()}
    assert got == {d: (n, gone, kept) for d, n, gone, kept in brute.substrings(rows)}
    assert sum(gone for _, gone, _ in got.values()) > 1000
