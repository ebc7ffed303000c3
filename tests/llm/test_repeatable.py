"""Scores that depend on nothing but their own row, and vectors of any size."""

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import ann, ftrl, quality


def test_quality_scores_do_not_depend_on_the_batch(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(9000, ""), (9001, None)], "doc_id long, text string"))
    weights = np.random.default_rng(1).normal(size=ftrl.DIM + 1)
    one, many = ({r.doc_id: r.score for r in quality.score(docs.repartition(n), weights).collect()} for n in (1, 7))
    assert one == many and len(one) == docs.count() and one[9000] == one[9001] == ftrl.sigmoid(weights[-1])


def test_vectors_of_any_size_have_the_same_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 12))
    sizes = np.array([1.0, 2.0**-560, 2.0**600, 1e-150, 1e150])[rng.integers(0, 5, 200)]

    def found(rows):
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
        return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(table, table.where(F.col("vec_id") % 50 == 0)).collect()}

    plain, large = found(x), found(x * sizes[:, None])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(large) == 20 and all(abs(s - unit[q] @ unit[v]) < 1e-12 for (q, _), (v, s) in large.items())
    assert len({k: v for k, v in large.items() if plain[k][0] == v[0]}) >= 18
