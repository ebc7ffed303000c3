"""The library: shelf, transcript, bookmarks, and the keyed tables behind them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Chunks to either side of the current one that a transcript shows; how near a bookmark counts as here.
TRANSCRIPT, NEAR_TOKENS = 120, 8


def shelve(books: DataFrame, times: DataFrame, progress: DataFrame) -> DataFrame:
    """books with remaining_s, fraction, started, finished. books: book_id, …; times: a timeline by doc_id; progress:
    book_id, chunk_idx. A saved position beyond the ends is taken as the nearest chunk."""
    saved = progress.select("book_id", F.col("chunk_idx").alias("saved"))
    chapters = times.withColumnRenamed("doc_id", "book_id").join(saved, "book_id", "left")
    here = F.when(F.col("chunk_idx") == F.greatest("saved", F.lit(0)), F.col("words_before"))
    whole = chapters.groupBy("book_id").agg(F.sum("words").alias("words"), F.max("chunk_idx").alias("last"), F.max(here).alias("here"), F.max_by("words_before", "chunk_idx").alias("at_last"))
    placed = books.join(whole, "book_id", "left").join(saved, "book_id", "left").withColumn("at", F.greatest(F.coalesce("saved", F.lit(0)), F.lit(0)))
    done = F.coalesce(F.when(F.col("saved").isNotNull(), F.coalesce("here", F.when(F.col("at") >= F.col("last"), F.col("at_last")))), F.lit(0))
    started = F.col("saved").isNotNull()
    return placed.select(
        *[F.col(c) for c in books.columns],
        F.round(T.estimate_seconds(F.greatest(F.coalesce("words", F.lit(0)) - done, F.lit(0))), 6).alias("remaining_s"),
        F.when(F.col("words") > 0, F.round(done / F.col("words"), 6)).otherwise(0.0).alias("fraction"),
        started.alias("started"),
        (started & (F.col("at") >= F.coalesce("last", F.lit(0)))).alias("finished"),
    )


def in_scope(shelf: DataFrame, scope: str) -> DataFrame:
    return shelf.where({"reading": "started and not finished", "finished": "finished"}.get(scope, "true"))


def search(shelf: DataFrame, needle: str) -> DataFrame:
    """Books whose "title author" holds the needle, whatever its case."""
    plain = F.lower(F.concat("title", F.lit(" "), F.coalesce("author", F.lit(""))))
    return shelf.where(plain.contains(needle.lower())) if needle else shelf


def sort_keys(sort: str) -> list[Column]:
    """title, remaining (least first), or added (newest first); ties by book_id."""
    return [{"title": F.collate("title", "UNICODE"), "remaining": F.col("remaining_s")}.get(sort, F.desc("added_at")), F.col("book_id")]


def placed(rows: DataFrame, *keys: Column) -> DataFrame:
    """rows with place, from 1, in the order of the keys, which must tell all rows apart.

    Rows are dealt by ranges of the keys and numbered inside each range; only the sizes of the ranges meet in one task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("part"))
    sizes = dealt.groupBy("part").count()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    return dealt.withColumn("within", within).join(F.broadcast(offsets), "part").select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("within") + F.col("before")).cast("int").alias("place"))


def extraction_details(stats: DataFrame, chunked: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, chunks, pages, margin_lines, footnote_lines, column_pages: what an ingest did to each document."""
    counts = chunked.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return stats.join(counts, "doc_id").join(pages.groupBy("doc_id").agg(F.count("*").alias("pages")), "doc_id").select("doc_id", "chunks", "pages", "margin_lines", "footnote_lines", "column_pages")


def save_books(books: DataFrame, path: str, buckets: int = 16) -> None:
    """Writes book rows to a table partitioned by a bucket of book_id; saved books of the same id are replaced.

    Only buckets that hold a new book are rewritten, each from what it held and the new rows, by way of a folder
    beside the table.
    Of new rows that repeat a book_id the last added counts. The last step puts the buckets in place one after another;
    a run that fails there leaves the rows in the folder beside the table, from where a second run brings them.
    """
    spark = books.sparkSession
    newest = Window.partitionBy("book_id").orderBy(F.desc("added_at"), *[F.col(c) for c in books.columns if c not in ("book_id", "added_at")])
    one = books.withColumn("k", F.row_number().over(newest)).where("k = 1").drop("k")
    new = one.withColumn("bucket", F.pmod(F.xxhash64("book_id"), F.lit(buckets)).cast("int"))
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        merged = new
    else:
        old = old.join(new.select("bucket").distinct(), "bucket", "left_semi").join(new.select("book_id"), "book_id", "left_anti")
        merged = old.unionByName(new)
    merged.write.mode("overwrite").parquet(f"{path}_next")
    spark.read.parquet(f"{path}_next").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def percent_read(chunk_idx: Column, chunks: Column) -> Column:
    """Whole percents, null at zero and below."""
    p = F.floor(chunk_idx * 100 / chunks).cast("int")
    return F.when((chunks > 0) & (p > 0), p)


def transcript(chunked: DataFrame, at: int, reach: int = TRANSCRIPT) -> DataFrame:
    return chunked.where((F.col("idx") >= at - reach) & (F.col("idx") < at + reach))


def transcript_blocks(chunked: DataFrame) -> DataFrame:
    """chunks with block: consecutive chunks of one paragraph, headings alone."""
    along = Window.partitionBy("doc_id").orderBy("idx")
    heading, para = F.lag("heading").over(along), F.lag("para").over(along)
    follows = heading.isNotNull() & ~heading & ~F.col("heading") & ~F.col("starts_para") & (F.col("para") == para)
    return chunked.withColumn("new", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("block", F.sum("new").over(along) - 1).drop("new")


def active_chapter(chapters: DataFrame, positions: DataFrame) -> DataFrame:
    """For each (doc_id, chunk_idx): the last chapter in list order at or before it, else the first one."""
    listed = chapters.select("doc_id", F.col("chunk_idx").alias("at"), F.struct("seq", "title").alias("row"), F.lit(False).alias("asked"))
    asked = positions.select("doc_id", F.col("chunk_idx").alias("at"), F.lit(None).cast(listed.schema["row"].dataType).alias("row"), F.lit(True).alias("asked")).distinct()
    whole = Window.partitionBy("doc_id")
    so_far = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = listed.unionByName(asked).withColumn("c", F.coalesce(F.max("row").over(so_far), F.min("row").over(whole)))
    return found.where("asked and c is not null").select("doc_id", F.col("at").alias("chunk_idx"), "c.seq", "c.title")


def chapter_step(active: DataFrame, chapters: DataFrame, step: int) -> DataFrame:
    """The chapter step places on from the active one, kept inside the list."""
    last = chapters.groupBy("doc_id").agg(F.max("seq").alias("last"))
    goal = active.join(last, "doc_id").select("doc_id", F.col("chunk_idx").alias("from_chunk"), F.least(F.greatest(F.col("seq") + step, F.lit(0)), F.col("last")).alias("seq"))
    return goal.join(chapters.select("doc_id", "seq", "title", "chunk_idx"), ["doc_id", "seq"])


def bookmark_here(bookmarks: DataFrame, positions: DataFrame, near: int = NEAR_TOKENS) -> DataFrame:
    """For each (book_id, chunk_idx, token_idx): the first bookmark of that chunk within near tokens.

    Tokens fall into bins of near; a bookmark that near lies in the position's bin or one beside it, so they meet by
    bin, and bookmarks of one token count once.
    """
    bin_of = lambda token: F.floor(token / max(1, near)).cast("long")
    firsts = bookmarks.groupBy("book_id", "chunk_idx", "token_idx").agg(F.min("id").alias("id")).withColumn("bin", bin_of(F.col("token_idx")))
    here = positions.select("book_id", "chunk_idx", F.col("token_idx").alias("at")).distinct()
    here = here.withColumn("bin", F.explode(F.transform(F.array(*[F.lit(k) for k in (-1, 0, 1)]), lambda k: bin_of(F.col("at")) + k)))
    met = here.join(firsts, ["book_id", "chunk_idx", "bin"]).where(F.abs(F.col("token_idx") - F.col("at")) <= near)
    return met.groupBy("book_id", "chunk_idx", F.col("at").alias("token_idx")).agg(F.min_by("id", F.struct("token_idx", "id")).alias("bookmark_id"))


def last_write_wins(writes: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The newest value of each key."""
    return writes.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.max(order[0]).alias(order[0]))


def delete_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


#: The tables whose rows go with their book; a book's voice is a setting and stays.
OF_A_BOOK = ("books", "files", "progress", "bookmarks")


def delete_books(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The library's tables without the books gone (column book_id): rows of OF_A_BOOK by book_id, audio by the book part of its key.

    Other tables stay as they are. A null book_id is never deleted.
    """
    ids = gone.select("book_id").distinct()
    out = dict(tables)
    for name in OF_A_BOOK:
        if name in out:
            out[name] = out[name].join(ids, "book_id", "left_anti")
    if "audio" in out:
        parts = ids.select(F.col("book_id").cast("string").alias("book_part"))
        out["audio"] = out["audio"].withColumn("book_part", F.split_part("key", F.lit(":"), F.lit(1))).join(parts, "book_part", "left_anti").drop("book_part")
    return out


def merged_settings(stored: Column, defaults: dict[str, str]) -> Column:
    """A map of settings with defaults under the stored ones."""
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(stored, k)), stored)


def valid_book_voices(settings: DataFrame) -> DataFrame:
    """book_id, voice_id, updated_at of well-formed `voice:<book>` settings (key, value as JSON)."""
    value = F.from_json("value", "voiceId string, updatedAt bigint", {"mode": "PERMISSIVE"})
    rows = settings.where(F.col("key").startswith("voice:")).select(F.substr("key", F.lit(7)).alias("book_id"), value.alias("v"))
    return rows.where("v.voiceId is not null and v.updatedAt is not null").select("book_id", F.col("v.voiceId").alias("voice_id"), F.col("v.updatedAt").alias("updated_at"))


def audio_key(cache_key: Column, voice_id: Column) -> Column:
    return F.concat(cache_key, F.lit(":"), F.coalesce(voice_id, F.lit("default")))


def evict_audio(cache: DataFrame, book_id: str) -> DataFrame:
    return cache.where(~F.col("key").startswith(f"{book_id}:"))


def audio_bytes(cache: DataFrame) -> DataFrame:
    return cache.agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0)).alias("bytes"))
