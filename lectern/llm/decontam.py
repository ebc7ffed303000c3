"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window of an item is contained in a document only if all its words are, so one prefix token, its rarest word, is
enough to find it. Document words meet window anchors in one join; each meeting fixes where the window would start,
positional and length bounds drop what would not fit, and the words there are compared with the window's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, only, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Everything between words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text whose A-Z are not yet lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
#: Stands after the last word of every document; no text holds it as a word.
END = "\u0000"
#: Windows that may be sent to every task; more are joined by a shuffle on the anchor word.
BROADCAST_WINDOWS = 100_000


def words_of(text: Column) -> Column:
    """The words of a text, their case kept. The split may leave an empty string at either end; null gives one."""
    return F.split(F.coalesce(text, F.lit("")), BETWEEN)


def count_of(parts: Column) -> Column:
    """How many words such a split holds."""
    return (F.size(parts) - F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def windows_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id and the distinct windows of each item: window (words joined by a space), len, anchor and its place.

    The anchor is the rarest word of the window over all items; ties go to the longer word, then to the smaller one,
    then to the first place. An item shorter than a window is one window; one without words has none.
    """
    words = items.select("item_id", F.array_remove(words_of(lower_ascii(F.col("text"))), "").alias("w")).where(F.size("w") > 0)
    often = words.select(F.explode("w").alias("word")).groupBy("word").count()
    starts = words.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1))).alias("at"))
    cut_out = starts.select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("w"))
    wide = cut_out.select("item_id", F.array_join("w", " ").alias("window"), F.size("w").alias("len"), F.posexplode("w").alias("place", "word"))
    rank = F.struct(F.col("count"), -F.length("word"), F.col("word"), F.col("place"))
    best = wide.join(often, "word").groupBy("window", "len").agg(F.min(rank).alias("r"), F.collect_set("item_id").alias("items"))
    return best.select("window", "len", "items", F.lower(F.col("r.word")).alias("anchor"), F.col("r.place").alias("place"))


def meetings(docs: DataFrame, windows: DataFrame, size: int = WINDOW) -> DataFrame:
    """Each place of a window in a document row, and one row with null start for each document row.

    Columns: row, doc_id, text_key, n_words, start, len, items. Up to BROADCAST_WINDOWS windows are sent to the tasks;
    beyond, document words travel to their anchors with the words around them.
    """
    few = windows.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    split = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    counted = split.select("row", "doc_id", "text_key", count_of(F.col("w")).alias("n_words"), "w", (F.size("w")).alias("n"))
    if few:
        closing = [F.lit(END if f.name == "anchor" else None).cast(f.dataType).alias(f.name) for f in windows.schema]
        anchors = windows.union(windows.sparkSession.range(1).select(*closing))
        dealt = counted.select("*", F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "word"))
        met = dealt.join(F.broadcast(anchors), F.lower("word") == F.col("anchor"))
        here, origin = F.col("w"), F.lit(0)
    else:
        # rows are numbered once, and the row without a start comes beside the join: joined to END all of them would meet
        counted = cut(counted)
        lead = F.greatest(F.col("pos") - size + 1, F.lit(0))
        near = counted.select("*", F.posexplode("w").alias("pos", "word")).withColumn("origin", lead).withColumn("w", F.slice("w", lead + 1, F.lit(2 * size - 1)))
        met = near.join(windows, F.lower("word") == F.col("anchor"))
        here, origin = F.col("w"), F.col("origin")
    start = F.col("pos") - F.col("place")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n"))
    found = F.when(fits, lower_ascii(F.array_join(F.slice(here, start - origin + 1, F.col("len")), " ")) == F.col("window"))
    places = met.where((F.col("word") == END) | F.coalesce(found, F.lit(False))).select("row", "doc_id", "text_key", "n_words", F.when(F.col("word") != END, start).alias("start"), "len", "items")
    if few:
        return places
    nowhere = [F.lit(None).cast(places.schema[c].dataType).alias(c) for c in ("start", "len", "items")]
    return places.unionByName(counted.select("row", "doc_id", "text_key", "n_words", *nowhere))


def scan(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row for each document row: doc_id, text_key (a hash of the text), n_words, n_hit, items, contaminated.

    items: the ids of the items with a window there, distinct, as sorted strings. Words are compared after lower-casing
    A-Z. A null or empty text has no words and is clean. Items without words are skipped; a null item_id hits words but
    is not listed. Repeated document rows are judged each on its own, repeated item rows count once. Empty tables give
    no rows, or clean ones. Other columns are ignored.
    """
    windows = cut(windows_of(only(items, "item_id", "text"), size))
    met = meetings(only(docs, "doc_id", "text"), windows, size)
    so_far = Window.partitionBy("row").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(so_far), F.lit(0))))
    each = met.select("*", F.coalesce(fresh, F.lit(0)).alias("fresh"))
    per_row = each.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text_key").alias("text_key"),
        F.first("n_words").alias("n_words"),
        F.sum("fresh").cast("long").alias("n_hit"),
        F.array_sort(F.transform(F.array_distinct(F.flatten(F.collect_set("items"))), lambda i: i.cast("string"))).alias("items"),
    )
    return per_row.select("doc_id", "text_key", "n_words", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs without the rows in which any word is hit; all columns are kept."""
    hit_id, hit_key = unused(docs, "hit_id", "hit_key")
    hit = scan(docs, items, size).where("contaminated").select(F.col("doc_id").alias(hit_id), F.col("text_key").alias(hit_key)).distinct()
    same = docs["doc_id"].eqNullSafe(F.col(hit_id)) & (F.xxhash64(docs["text"]) == F.col(hit_key))
    return docs.join(hit, same, "left_anti")
