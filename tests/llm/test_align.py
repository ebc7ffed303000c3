"""Byte-owner alignment against whole texts encoded one by one."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lectern.llm import align
from lectern.llm import queries as Q

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "a", " lead", "trail  ", "two  spaces   three", "tab\tand\nline \n\n mix", "a▁b is not kept", "été déjà vu　x   y", "<|endoftext|> <s> </s> <0x41> <unk>",
    "don't we'll I'M", "12345 678,90 3.14", "日本語のテキスト と 漢字", "😀😀 👩‍👩‍👧 z", "nul\x00byte \x1f x", "x" * 3000, "é" * 700 + " " + "-" * 500, " ", "same words same words same words", "a\u0085b c  d",
]


def brute(rows):
    """The contract word for word: no segments, no blocks, no arrays."""
    a, b = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(sorted(set(range(256)) - set(plain)))}
    linked, out = [], []
    for doc_id, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            ids_a = ids_b = bytes_a = bytes_b = []
        end_a, end_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        shared = sorted(set(end_a) & set(end_b))
        groups, links = [], Counter()
        for lo, hi in zip([0, *shared], shared):
            x, y = [i for i, e in zip(ids_a, end_a) if lo < e <= hi], [i for i, e in zip(ids_b, end_b) if lo < e <= hi]
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
            links.update((i, j) for i in x for j in y)
        linked.append(links)
        out.append([doc_id, len(ids_a), len(ids_b), len(groups), sum(links.values()), 0, 0, sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    count = Counter(k for links in linked for k in links)
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    for row, links in zip(out, linked):
        row[5] = sum(m for k, m in links.items() if count[k] == best[k[0]])
        row[6] = sum(m * count[k] for k, m in links.items())
    return sorted(map(tuple, out), key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_awkward_texts_equal_brute_force(spark):
    pick = random.Random(5)
    texts = TEXTS + ["".join(pick.choice(" \n\tab é語😀.,'1▁" if i % 5 else "ab c. d") for _ in range(pick.randrange(1, 90))) for i in range(150)]
    docs = [(i % 160, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (7, TEXTS[7])]
    table = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, block int, pair string").repartition(3)
    assert rows(align.align(table, BYTE, PIECE)) == brute(docs)
    assert align.align(table.where("doc_id < -1"), BYTE, PIECE).count() == 0


def test_whole_table_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(Q.op12_alignment(spark, folder)) == brute(docs)


@pytest.mark.parametrize("text", ["plain words here", "antidisestablishmentarianism 日本 don't", "x" * 500])
def test_owner_arrays(text):
    both = align.Pair(open(BYTE, encoding="utf-8").read(), open(PIECE, "rb").read())
    ((a, b),) = both.encode([" " + text])
    own_a, own_b = align.owners(a, both.bytes_a), align.owners(b, both.bytes_b)
    assert len(own_a) == len(own_b) == len((" " + text).encode())
    shared = align.overlaps(own_a, own_b)
    assert set(map(tuple, shared.tolist())) == set(zip(own_a.tolist(), own_b.tolist()))
    ends = lambda ids, known: set(np.cumsum([len(known[i]) for i in ids]).tolist())
    assert set(align.cuts(own_a, own_b).tolist()) - {0} == (ends(a, both.bytes_a) & ends(b, both.bytes_b)) - {len(own_a)}


def test_long_group_lists_each_pair_once(monkeypatch):
    a, b = np.array([1, 2, 1] * 5), np.array([7] * 4 + [8] * 6)
    ends = [np.array([x]) for x in (0, 0, 15, 10, 0)]
    want = Counter((int(i) << 32) | int(j) for i in a for j in b)
    for most in (4096, 8):
        monkeypatch.setattr(align, "LONG_GROUP", most)
        many, keys, times = align.Segments._pairs(a, b, *ends, 1)
        got = Counter()
        for k, t in zip(keys.tolist(), times.tolist()):
            got[k] += t
        assert got == want and many.tolist() == [len(keys)] and len(keys) == (150 if most == 4096 else 4)
