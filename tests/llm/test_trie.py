"""The prefix trie against a dictionary of prefixes, and against SQL."""

from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from lectern.llm import queries as Q
from lectern.llm import trie
from lectern.llm.oracle import oracle_sql

SMALL = "/root/testdata/sf0.001"


def brute(rows):
    """The contract word for word, from a dictionary of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        head = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(head, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = []
    for prefix, convs in members.items():
        under = [p for p in members if p[: len(prefix)] == prefix]
        kids = [p for p in under if len(p) == len(prefix) + 1]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p)
        ends = ",".join(str(c) for c in sorted(convs) if built[c] == prefix)
        out.append((min(convs), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(convs), len(kids), len(leaves), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(spark, rows):
    table = spark.createDataFrame([(*r, b"n", 1) for r in rows], "conv_id long, turn long, role string, text string, node binary, place int").repartition(5)
    return sorted(map(tuple, trie.prefix_trie(*trie.with_shared_heads(trie.ordered(table))).collect()), key=str)


def awkward():
    rows = [(c, t, "user" if t % 2 else "assistant", f"same {t}") for c in (3, 5, 9, 700) for t in range(70)]  # deep copies
    rows += [(c, t, "user", f"own {c} {t}") for c in range(200, 240) for t in range(c % 9)]
    rows += [(100, 2, "user", "b"), (100, None, "user", "first"), (100, 1, None, None), (100, 1, "user", "tie b"), (100, 1, "user", "tie a"), (100, 1, "user", "tie a")]
    rows += [(101, 0, "user", "é😀"), (102, 0, "user", "é😀"), (None, 0, "user", "nobody"), (-7, 1, "user", "below"), (-100, 1, "user", "zero"), (150, 4, None, None)]
    return rows


def test_equals_dictionary_of_prefixes(spark):
    assert rows_of(spark, awkward()) == brute(awkward())


def test_small_tables(spark):
    assert rows_of(spark, [(None, 1, "a", "b")]) == []
    one = [(8, 1, "user", "x"), (8, 2, "user", "y")]
    assert rows_of(spark, one) == brute(one)
    same = [(c, t, "user", "x" * t) for c in (400, 401, 402, 403) for t in range(7)]
    assert rows_of(spark, same) == brute(same)


def test_awkward_rows_equal_sql(spark, tmp_path):
    c, t, r, x = zip(*awkward())
    pq.write_table(pa.table({"conv_id": pa.array(c, pa.int64()), "turn": pa.array(t, pa.int64()), "role": pa.array(r, pa.string()), "text": pa.array(x, pa.string())}), tmp_path / "conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet'")
    want = sorted(con.execute(f"select conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 from ({oracle_sql()['op13_prefix_trie']})").fetchall(), key=str)
    assert want == brute(awkward())
    assert sorted(map(tuple, Q.op13_prefix_trie(spark, str(tmp_path)).collect()), key=str) == want
