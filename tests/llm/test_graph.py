"""Connected components against union-find."""

import random

import pytest

from lectern.llm import graph


def roots(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("block", [4, graph.BLOCK])
def test_components_of_paths_stars_and_random_links(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    rng = random.Random(3)
    ids = rng.sample(range(-5000, 5000), 700)
    path = list(zip(ids[:300], ids[1:300]))
    star = [(ids[300], x) for x in ids[301:400]]
    loose = [(rng.choice(ids[400:]), rng.choice(ids[400:])) for _ in range(220)]
    edges = path + star + loose + path[:20] + [(None, ids[0]), (ids[0], None), (7777, 7777)]
    rng.shuffle(edges)
    found = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert len(found) == len({r["node"] for r in found})
    assert {r["node"]: r["root"] for r in found} == roots(edges)


def test_no_links(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []
