"""Synthesis behind its cache, the cascade, lookups by bins and pages, page ingest, and saved books."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import storage as S
from lectern.operators import chunks as C
from lectern.operators import layout as L
from lectern.operators import library as B
from lectern.plans import ingest, synthesis
from lectern.sources import adapters as A

SMALL = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns or df.columns).collect()), key=str)


def engine():
    def speak(text, voice):
        if text is None or "bad" in text:
            raise RuntimeError("no voice for that")
        return f"{voice}/{text}".encode()

    return speak


def test_a_failing_text_stops_no_other_and_is_asked_again(spark, tmp_path):
    path = str(tmp_path / "audio")
    said = spark.createDataFrame([("1:0:0", "one", None), ("1:0:0", "one", None), ("1:0:1", "bad two", "v"), ("1:0:2", "three", "v"), ("1:0:3", None, "v")], "cache_key string, speech string, voice_id string")
    first = {r["key"]: (r["status"], r["error"], r["blob"] and bytes(r["blob"])) for r in synthesis.get_or_synthesize(said, path, engine()).collect()}
    refused = ("failed", "RuntimeError: no voice for that", None)
    assert first == {"1:0:0:default": ("made", None, b"None/one"), "1:0:1:v": refused, "1:0:2:v": ("made", None, b"v/three"), "1:0:3:v": refused}
    assert rows(spark.read.parquet(path), "key") == [("1:0:0:default",), ("1:0:2:v",)]
    second = synthesis.get_or_synthesize(said, path, lambda text, voice: b"now")
    assert {r["key"]: r["status"] for r in second.collect()} == {"1:0:0:default": "cached", "1:0:1:v": "made", "1:0:2:v": "cached", "1:0:3:v": "made"}
    assert spark.read.parquet(path).count() == 4 == spark.read.parquet(path).select("key").distinct().count()


def test_a_cache_that_fails_costs_no_audio(spark, tmp_path):
    said = spark.createDataFrame([("1:0:0", "one", "v")], "cache_key string, speech string, voice_id string")
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"not parquet")
    assert rows(synthesis.get_or_synthesize(said, str(tmp_path / "broken"), engine()), "key", "status") == [("1:0:0:v", "made")]
    (tmp_path / "file").write_text("in the way")
    assert rows(synthesis.get_or_synthesize(said, str(tmp_path / "file" / "audio"), engine()), "key", "status") == [("1:0:0:v", "made")]


def test_cascade(spark):
    ids = lambda *values: spark.createDataFrame([(v,) for v in values], "book_id long")
    keys = lambda *values: spark.createDataFrame([(v,) for v in values], "key string")
    tables = {"books": ids(1, 2, 12), "files": ids(1, 2), "progress": ids(2, None), "bookmarks": ids(1, 1, 2), "audio": keys("1:0:0:v", "12:0:0:v", "2:1:0:v", "odd", None), "voices": keys("voice:1")}
    left = B.delete_books(tables, ids(1, 1, 99))
    assert {k: rows(v) for k, v in left.items()} == {
        "books": [(12,), (2,)], "files": [(2,)], "progress": [(2,), (None,)], "bookmarks": [(2,)], "audio": [("12:0:0:v",), ("2:1:0:v",), ("odd",), (None,)], "voices": [("voice:1",)],
    }


@pytest.mark.parametrize("near", [8, 1, 0])
def test_bookmarks_by_bins_equal_all_pairs(spark, near):
    pick = random.Random(near)
    marks = [(i, pick.randrange(3), pick.randrange(3), pick.randrange(-20, 60)) for i in range(300)]
    here = [(pick.randrange(4), pick.randrange(3), pick.randrange(-25, 65)) for _ in range(200)]
    want = []
    for b, c, t in set(here):
        close = [(tok, i) for i, bb, cc, tok in marks if (bb, cc) == (b, c) and abs(tok - t) <= near]
        want += [(b, c, t, min(close)[1])] if close else []
    made = B.bookmark_here(spark.createDataFrame(marks, "id long, book_id long, chunk_idx int, token_idx int"), spark.createDataFrame(here, "book_id long, chunk_idx int, token_idx int"), near)
    assert rows(made) == sorted(want, key=str)
    assert "CartesianProduct" not in made._jdf.queryExecution().toString() and "bin" in made._jdf.queryExecution().toString()


def test_outline_by_pages_equals_all_pairs(spark):
    pick = random.Random(6)
    texts = ["The weir", "A mill by the weir", "Reeds", "the Weir again"]
    chunks = [(d, i, pick.choice(texts), 1 + i // 3) for d in range(3) for i in range(20)]
    outline = [(d, k, pick.choice([*texts, None]), pick.choice([None, *range(0, 10)]), None) for d in range(4) for k in range(30)]
    plain = lambda t: None if t is None else t.lower()
    want = []
    for d, k, title, page, level in outline:
        met = [c for c in chunks if c[0] == d and page is not None and page <= c[3] <= page + 1]
        exact = [c[1] for c in met if c[3] == page and title is not None and plain(c[2]).startswith(plain(title)[:24])]
        want += [(d, k, title, (exact or [min(c[1] for c in met)])[0], page, level)] if met else []
    made = C.outline_chapters(spark.createDataFrame(chunks, "doc_id long, idx int, text string, page int"), spark.createDataFrame(outline, "doc_id long, seq int, title string, page int, level int"))
    assert rows(made) == sorted(want, key=str)


def test_gutters_equal_counting_every_candidate(spark):
    pick = random.Random(9)
    data, want = [], []
    for page in range(60):
        width = pick.choice([612.0, 595.3, 100.0])
        lines = [(x, x + width * pick.choice([0.05, 0.3, 0.4, 0.6, 0.0])) for x in (width * pick.choice([0.05, 0.1, 0.5, 0.52, 0.6]) for _ in range(pick.randrange(1, 25)))]
        data += [(page % 4, page, x0, x1, width) for x0, x1 in lines]
        tried = []
        for i, f in enumerate(L.gutter_fractions()):
            x, n = width * f, len(lines)
            crossings = sum(a < x < b for a, b in lines)
            left = sum(b <= x for _, b in lines)
            tried.append((crossings, -min(left, n - crossings - left) / n, i, x))
        crossings, balance, _, x = min(tried)
        want += [(page % 4, page, x)] if len(lines) >= 6 and crossings / len(lines) <= 0.15 and -balance >= 0.2 else []
    made = L.gutters(spark.createDataFrame(data, "doc_id long, page int, x0 double, x1 double, width double"))
    assert rows(made) == sorted(want, key=str) and 5 < len(want) < 60


def test_page_ingest_reads_its_lines_once_for_all_outputs(spark):
    lines = S.stored(A.typeset(spark, SMALL)[0].where("doc_id < 30"))
    pages = A.pages_of(lines)
    made = ingest.ingest_pages(lines, pages)
    for name in ("books", "chunks", "chapters", "stats", "paragraphs"):
        assert not any("documents.parquet" in f for f in made[name].inputFiles())
    assert rows(made["chunks"]) == rows(C.chunks(L.paragraphs(lines, pages)))
    assert rows(made["stats"].drop("page_count")) == rows(L.clean_stats(lines, pages))
    books, chunked = made["books"], made["chunks"]
    assert books.agg(F.sum("chunk_count")).first()[0] == chunked.count() and books.count() == chunked.select("doc_id").distinct().count()
    typeset = A.typeset(spark, SMALL)[0]._jdf.queryExecution().executedPlan().toString()
    assert typeset.count("documents.parquet") == 1


def test_saved_books_let_other_errors_rise(spark, tmp_path):
    path = str(tmp_path / "books")
    books = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (2, "b late", 9)], "book_id long, title string, added_at long")
    B.save_books(books, path)
    B.save_books(spark.createDataFrame([(1, "a2", 1)], "book_id long, title string, added_at long"), path)
    assert rows(spark.read.parquet(path), "book_id", "title") == [(1, "a2"), (2, "b late")]
    with pytest.raises(Exception, match="nosuchscheme"):
        B.save_books(books, "nosuchscheme://x/y")
