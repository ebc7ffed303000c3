"""Whole ingests: positioned lines or e-book archives to paragraphs, chunks, chapters and book rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import storage as S
from lectern.functions import text as T
from lectern.operators import assembly as D
from lectern.operators import chunks as C
from lectern.operators import markup as M
from lectern.sources.archives import entries


def book_rows(chunked: DataFrame) -> DataFrame:
    """doc_id, chunk_count, word_count of every document with a chunk."""
    return chunked.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum(T.count_words(F.col("text"))).alias("word_count"))


def ingest_pages(lines: DataFrame, pages: DataFrame, outline: DataFrame | None = None) -> dict[str, DataFrame]:
    """paragraphs, chunks, chapters, stats and books of positioned lines; documents without text have no rows.

    Documents with their paragraphs, and chunks, are written to the shared folder: each has several readers. The lines,
    which may be dear to make, are read once and not written; those that are dealt by doc_id do not move.
    """
    documents = S.stored(D.documents(lines, pages))
    chunked = S.stored(C.document_chunks(documents))
    stats = documents.drop("paragraphs")
    return {"paragraphs": D.paragraphs(documents), "chunks": chunked, "chapters": C.chapters(chunked, outline), "stats": stats, "books": book_rows(chunked).join(stats, "doc_id")}


def ingest_markup(documents: DataFrame) -> dict[str, DataFrame]:
    """The same for content documents (doc_id, markup), one section each."""
    paragraphs = M.paragraphs(M.tokens(documents), "doc_id").withColumn("page", F.lit(1))
    chunked = C.chunks(paragraphs)
    return {"paragraphs": paragraphs, "chunks": chunked, "chapters": C.chapters(chunked), "books": book_rows(chunked)}


def ingest_epub(files: DataFrame) -> dict[str, DataFrame]:
    """The same for e-book archives (path, content), doc_id being the path; each archive is unpacked once."""
    return ingest_book_files(entries(files).select(F.col("path").alias("doc_id"), "name", F.decode("content", "UTF-8").alias("markup")))


def ingest_book_files(files: DataFrame) -> dict[str, DataFrame]:
    """The same for the unpacked files of e-books (doc_id, name, markup).

    Sections are numbered by their place in the reading order even where a file is missing; the table of contents
    comes from the navigation document, else from the NCX, else from headings. Of files that repeat a name the one with
    the greatest markup counts. Files, reading orders, contents tables and chunks are written to the shared folder.
    """
    named = S.stored(files.groupBy("doc_id", "name").agg(F.max("markup").alias("markup")))
    keys, opf = ["doc_id", "opf_path"], F.col("opf_path")
    paths = M.container_path(M.tokens(named.where("name = 'META-INF/container.xml'").drop("name")), "doc_id")
    rows = M.tokens(S.stored(named.join(paths.withColumnRenamed("opf_path", "name"), ["doc_id", "name"]).withColumnRenamed("name", "opf_path")))
    info = S.stored(M.package_info(rows, opf, *keys))
    spine = M.spine(rows, opf, *keys).join(info.select("doc_id", "nav_path"), "doc_id").where("nav_path is null or path <> nav_path")
    order = Window.partitionBy("doc_id").orderBy("seq")
    sections = S.stored(spine.select("doc_id", "path", F.row_number().over(order).alias("page")))
    content = sections.join(named.withColumnRenamed("name", "path"), ["doc_id", "path"])
    found = M.paragraphs(M.tokens(content.select("doc_id", "page", "markup")), "doc_id", "page")
    paragraphs = found.withColumn("para", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "para")) - 1)
    chunked = S.stored(C.chunks(paragraphs))
    entry = lambda kind: M.tokens(info.where(f"{kind}_path is not null").select("doc_id", f"{kind}_path").join(named.withColumnRenamed("name", f"{kind}_path"), ["doc_id", f"{kind}_path"]))
    nav = M.nav_entries(entry("nav"), F.col("nav_path"), "doc_id", "nav_path").drop("nav_path")
    ncx = M.ncx_entries(entry("ncx"), F.col("ncx_path"), "doc_id", "ncx_path").drop("ncx_path")
    toc = S.stored(M.toc(nav, ncx, "doc_id"))
    chapters = C.toc_chapters(chunked, toc, sections.withColumnRenamed("page", "section"))
    pages = sections.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    title = F.coalesce(T.usable_title(F.col("title")), F.regexp_replace(F.regexp_extract(F.col("doc_id").cast("string"), r"[^/]+$", 0), r"(?i)\.epub$", ""))
    about = info.select("doc_id", title.alias("title"), T.usable_author(F.col("author")).alias("author"))
    return {"paragraphs": paragraphs, "chunks": chunked, "toc": toc, "chapters": chapters, "books": book_rows(chunked).join(pages, "doc_id").join(about, "doc_id")}
