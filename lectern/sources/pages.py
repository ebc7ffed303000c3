"""Positioned text of paged documents: runs, page sizes and properties, as tables of an extractor, to lines and book facts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import layout as L


def scan(runs: DataFrame, pages: DataFrame, properties: DataFrame) -> dict[str, DataFrame]:
    """lines, pages and about of documents.

    runs: doc_id, page, seq, text, x0, x1, y, font_size, a null text being no text item; pages: doc_id, page, width,
    height, one row for each page whether it holds text or not; properties: doc_id, title, author as the file has them.
    lines are the runs grouped on their pages; about has every document that has a page, with its trimmed title (empty
    where it has none), its trimmed author (null where it has none) and page_count. Runs on a page that is not listed go.
    """
    return scan_pages(L.packed_runs(runs), pages, properties)


def scan_pages(run_pages: DataFrame, pages: DataFrame, properties: DataFrame, runs: Callable[[pa.RecordBatch], dict] | None = None) -> dict[str, DataFrame]:
    """The same where the runs come page by page: run_pages has doc_id, page and runs, an array, or what the function
    runs reads (see layout.paged_lines). Also counts: how many lines and characters a page holds, listed or not, which
    no line moves for."""
    sizes = pages.groupBy("doc_id", "page").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    paged = L.paged_lines(run_pages, runs)
    counts = paged.select("doc_id", "page", F.size("lines").cast("long").alias("lines"), F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"])).alias("chars"))
    # lines, not runs, meet the listed pages, since they are smaller; a semi join would sink below the grouping of runs
    lines = L.page_lines(run_pages, runs).join(sizes.select("doc_id", "page").hint("shuffle_hash"), ["doc_id", "page"])
    named = properties.groupBy("doc_id").agg(F.max(T.trimmed(F.col("title"))).alias("title"), F.max(T.trimmed(F.col("author"))).alias("author"))
    counted = sizes.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    about = counted.join(named, "doc_id", "left").select("doc_id", F.coalesce("title", F.lit("")).alias("title"), F.nullif("author", F.lit("")).alias("author"), "page_count")
    return {"lines": lines, "pages": sizes, "about": about, "counts": counts}
