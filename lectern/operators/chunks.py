"""Paragraphs into sentences and chunks, and the chapters that index them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

#: Characters that a chunk aims at, and that a sentence may have before it is cut.
TARGET, MOST = 320, 480
#: Characters of a heading that make a chapter's title.
TITLE = 120
#: Heading chunks beyond which only those that name a chapter count.
MANY_HEADINGS = 80
CHAPTER_WORDS = r"(?i)^(chapter|part|section|book|appendix|prologue|epilogue|introduction|conclusion|preface|foreword)(?![A-Za-z0-9_])"


def hard_split(sentence: Column) -> Column:
    """An over-long sentence cut at clause ends, then between words; a single huge word stays whole."""
    clauses = T.packed(F.split(sentence, rf"(?<=[,;:—]){T.SPACE}+"), TARGET)
    return F.flatten(F.transform(clauses, lambda p: F.when(F.length(p) <= MOST, F.array(p)).otherwise(T.packed(F.split(p, " "), TARGET))))


def pack_sentences(found: Column) -> Column:
    """Chunks of a paragraph's sentences; over-long ones are cut and never share a chunk."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def add(state: Column, s: Column) -> Column:
        long = F.length(s) > MOST
        held = F.when(state["now"] != "", F.array(state["now"])).otherwise(F.array().cast("array<string>"))
        full = (state["now"] != "") & (F.length(state["now"]) + F.length(s) + 1 > TARGET)
        out = F.when(long, F.concat(state["out"], held, hard_split(s))).when(full, F.concat(state["out"], held)).otherwise(state["out"])
        now = F.when(long, "").when(full | (state["now"] == ""), s).otherwise(F.concat(state["now"], F.lit(" "), s))
        return F.struct(out.alias("out"), now.alias("now"))

    return F.filter(F.aggregate(found, start, add, lambda s: F.concat(s["out"], F.array(s["now"]))), lambda x: x != "")


def sentences(paragraphs: DataFrame) -> DataFrame:
    """doc_id, para, sid, text: a paragraph's sentences, without a shuffle."""
    return paragraphs.select("doc_id", "para", F.posexplode(T.sentences(F.col("text"))).alias("sid", "text"))


def chunks(paragraphs: DataFrame) -> DataFrame:
    """doc_id, idx, text, page, para, starts_para, heading; headings stay whole."""
    pieces = F.when(F.col("heading"), F.array("text")).otherwise(pack_sentences(T.sentences(F.col("text"))))
    cut = paragraphs.select("doc_id", "page", "para", "heading", F.posexplode(pieces).alias("piece", "text"))
    order = Window.partitionBy("doc_id").orderBy("para", "piece")
    return cut.select("doc_id", (F.row_number().over(order) - 1).alias("idx"), "text", "page", "para", (F.col("piece") == 0).alias("starts_para"), "heading")


def document_chunks(documents: DataFrame) -> DataFrame:
    """The chunks of doc_id and paragraphs, an array of (text, page, heading) for each document, without a shuffle."""

    def pieces(p: Column, para: Column) -> Column:
        cut = F.when(p["heading"], F.array(p["text"])).otherwise(pack_sentences(T.sentences(p["text"])))
        return F.transform(cut, lambda t, k: F.struct(t.alias("text"), p["page"].alias("page"), para.alias("para"), (k == 0).alias("starts_para"), p["heading"].alias("heading")))

    cut = F.flatten(F.transform("paragraphs", pieces))
    return documents.select("doc_id", F.posexplode(cut).alias("idx", "c")).select("doc_id", "idx", "c.*")


def heading_chapters(chunked: DataFrame) -> DataFrame:
    """doc_id, title, chunk_idx, page, level of heading chunks; of very many, only those that name a chapter."""
    named = F.col("text").rlike(CHAPTER_WORDS)
    marked = chunked.where("heading").withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).where((F.col("n") <= MANY_HEADINGS) | named)
    return marked.select("doc_id", F.substring("text", 1, TITLE).alias("title"), F.col("idx").alias("chunk_idx"), "page", F.when(named, 0).otherwise(1).alias("level"))


def outline_chapters(chunked: DataFrame, outline: DataFrame) -> DataFrame:
    """Outline entries at the chunk on their page that starts with their title, else the first there or on the next.

    seq tells the entries of a document apart. Entries meet the chunks of their own page, and of the next page only its first.
    """
    head = F.substring(T.match_title(F.col("title")), 1, 24)
    entries = outline.where(F.col("page").isNotNull()).select("doc_id", "seq", "title", F.col("page").alias("at"), "level", head.alias("head"))
    first = chunked.groupBy("doc_id", "page").agg(F.min("idx").alias("idx"))
    near = entries.withColumn("page", F.explode(F.array("at", F.col("at") + 1))).join(first, ["doc_id", "page"])
    near = near.groupBy("doc_id", "seq", "title", "at", "level").agg(F.min("idx").alias("near"))
    plain = chunked.select("doc_id", "idx", F.col("page").alias("at"), T.match_title(F.col("text")).alias("plain"))
    exact = entries.join(plain, ["doc_id", "at"]).where(F.col("plain").startswith(F.col("head"))).groupBy("doc_id", "seq").agg(F.min("idx").alias("exact"))
    return near.join(exact, ["doc_id", "seq"], "left").select("doc_id", "seq", "title", F.coalesce("exact", "near").alias("chunk_idx"), F.col("at").alias("page"), "level")


def chapters(chunked: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """doc_id, seq, title, chunk_idx, page, level: the outline if it gives two or more, else headings; a first
    chapter "Beginning" where none starts at the first chunk; of several at one chunk the first stays."""
    headings = heading_chapters(chunked).withColumn("seq", F.col("chunk_idx"))
    if outline is None:
        chosen = headings
    else:
        marks = outline_chapters(chunked, outline).withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).where("n >= 2").drop("n")
        chosen = marks.unionByName(headings.join(marks.select("doc_id").distinct(), "doc_id", "left_anti"))
    first = chunked.where("idx = 0").select("doc_id", F.lit(-1).alias("seq"), F.lit("Beginning").alias("title"), F.col("idx").alias("chunk_idx"), "page", F.lit(0).alias("level"))
    missing = first.join(chosen.where("chunk_idx = 0").select("doc_id").distinct(), "doc_id", "left_anti")
    order = Window.partitionBy("doc_id", "chunk_idx").orderBy("seq")
    kept = chosen.unionByName(missing).withColumn("k", F.row_number().over(order)).where("k = 1")
    along = Window.partitionBy("doc_id").orderBy("chunk_idx")
    return kept.select("doc_id", (F.row_number().over(along) - 1).alias("seq"), "title", "chunk_idx", "page", "level")


def toc_chapters(chunked: DataFrame, toc: DataFrame, sections: DataFrame) -> DataFrame:
    """Chapters from table-of-contents entries: an entry stands at its section's first chunk, the first entry of a
    chunk wins, entries keep their order; fewer than two chapters give the headings instead."""
    starts = chunked.groupBy("doc_id", F.col("page").alias("section")).agg(F.min("idx").alias("chunk_idx"))
    placed = toc.join(sections.withColumnRenamed("path", "href"), ["doc_id", "href"]).join(starts, ["doc_id", "section"])
    one = placed.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "chunk_idx").orderBy("seq"))).where("k = 1")
    one = one.withColumn("n", F.count("*").over(Window.partitionBy("doc_id"))).where("n >= 2")
    marks = one.select("doc_id", "seq", "title", "chunk_idx", F.col("section").alias("page"), "level")
    first = marks.groupBy("doc_id").agg(F.min_by("chunk_idx", "seq").alias("f")).where("f > 0").select("doc_id")
    begin = chunked.where("idx = 0").join(first, "doc_id", "left_semi").select("doc_id", F.lit(-1).alias("seq"), F.lit("Beginning").alias("title"), F.col("idx").alias("chunk_idx"), "page", F.lit(0).alias("level"))
    rest = chapters(chunked.join(marks.select("doc_id").distinct(), "doc_id", "left_anti"))
    along = Window.partitionBy("doc_id").orderBy("seq")
    return marks.unionByName(begin).withColumn("seq", F.row_number().over(along) - 1).unionByName(rest)
