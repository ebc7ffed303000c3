"""Neighbours where rows of another length lie in the table."""

from lectern.llm import ann


def test_longer_rows_do_not_empty_the_result(spark):
    rows = [(i, [1.0 + i, 2.0, 3.0 - i]) for i in range(6)] + [(10, [1.0, float("nan"), 1.0, 1.0]), (11, [1.0, 2.0, 3.0, 4.0, 5.0]), (12, [1.0, 2.0, 3.0, 4.0, 6.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.search(vectors, vectors.where("vec_id in (0, 10, 11)"), 2).collect()
    assert sorted((r["query_id"], r["rank"]) for r in found) == [(0, 1), (0, 2), (11, 1)]
    assert [r["vec_id"] for r in found if r["query_id"] == 11] == [12]
