"""One query for each operator of the blueprint: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import storage as S
from lectern.functions import text as T
from lectern.operators import assembly as D
from lectern.operators import chunks as C
from lectern.operators import glyphs as G
from lectern.operators import layout as L
from lectern.operators import library as B
from lectern.operators import markup as M
from lectern.operators import outline as O
from lectern.operators import schedule as N
from lectern.operators import voices as V
from lectern.plans import ingest as E
from lectern.plans import synthesis as Y
from lectern.sources import adapters as A
from lectern.sources import archives as Z
from lectern.sources import extractor as X
from lectern.sources import pages as K
from lectern.streaming import highlight as H
from lectern.streaming import ingest as I
from lectern.streaming import player as P

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    REGISTRY[f.__name__] = f
    return f


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.chunks(A.paragraphs(spark, d))


def _page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return M.paragraphs(M.tokens(A.content_documents(spark, d)), "doc_id")


def _page_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.chunks(_page_paragraphs(spark, d).withColumn("page", F.lit(1)))


def _flags(df: DataFrame) -> DataFrame:
    """Booleans as numbers, so that every engine prints them alike."""
    return df.select(*[F.col(f.name).cast("int").alias(f.name) if f.dataType.simpleString() == "boolean" else F.col(f.name) for f in df.schema])


def _thousandths(c: str) -> Column:
    """Rounded to three places; whole numbers, which most are, need no decimal arithmetic."""
    return F.when(F.col(c) == F.rint(c), F.col(c)).otherwise(F.round(c, 3)).alias(c)


# --- sources ---------------------------------------------------------------------------------------------------------
@query
def s1_format(spark, d):
    return A.read(spark, d, "pages").select("page_id", Z.book_format(F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".EPUB"))).otherwise(F.col("url"))).alias("format"))


@query
def s2_supported(spark, d):
    name = F.concat("url", F.when(F.col("page_id") % 3 == 0, F.lit(".epub")).when(F.col("page_id") % 3 == 1, F.lit(".Pdf")).otherwise(F.lit(".txt")))
    return A.read(spark, d, "pages").where(Z.supported(name)).select("page_id")


def _book_files(spark, d, like):
    """The tokens of the books' files with such a name, and their paths."""
    return M.tokens(A.book_files(spark, d).where(F.col("name").like(like)).withColumnRenamed("name", "opened"))


@query
def s7_container(spark, d):
    return M.container_path(_book_files(spark, d, "META-INF/container.xml"), "doc_id")


@query
def s8_spine(spark, d):
    return M.spine(_book_files(spark, d, "%.opf"), F.col("opened"), "doc_id", "opened").drop("opened")


@query
def s8_package(spark, d):
    return M.package_info(_book_files(spark, d, "%.opf"), F.col("opened"), "doc_id", "opened").drop("opened")


@query
def s9_resolve_path(spark, d):
    href = F.get(F.array(*[F.lit(h) for h in A.HREFS]), (F.col("page_id") % len(A.HREFS)).cast("int"))
    base = F.regexp_replace("url", "^https?://", "")
    return A.read(spark, d, "pages").select("page_id", T.resolve_path(base, href).alias("path"))


@query
def s10_tokens(spark, d):
    rows = M.tokens(A.content_documents(spark, d))
    return rows.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"), F.max("pos").alias("last_pos"))


@query
def s10_names(spark, d):
    rows = M.tokens(A.content_documents(spark, d)).where("kind <> 'text'")
    return rows.groupBy("kind", "name").agg(F.count("*").alias("n"))


@query
def s11_entities(spark, d):
    rows = A.read(spark, d, "pages").select("page_id", F.regexp_replace("html", "<", "&lt;").alias("t"))
    return rows.select("page_id", F.md5(M.decode_entities(F.col("t")).cast("binary")).alias("decoded"))


@query
def s14_parse_voices(spark, d):
    setting = F.format_string("a%1$d:%2$s, b%1$d:%2$s: bright,,c%1$d", "pos", "name")
    rows = A.voices(spark, d).select("pos", setting.alias("setting"))
    return rows.select(F.col("pos").alias("n"), F.posexplode(V.parse_voices(F.col("setting"))).alias("place", "v")).select("n", "place", "v.id", "v.name", "v.lang")


@query
def s4_glyph_runs(spark, d):
    runs = G.page_runs(A.set_pages(spark, d), X.boxes)
    return runs.select("doc_id", "page", "seq", "text", _thousandths("x0"), _thousandths("x1"), "y", "font_size")


# --- layout ----------------------------------------------------------------------------------------------------------
@query
def l1_group_lines(spark, d):
    lines = L.page_lines(A.set_pages(spark, d), X.runs)
    return lines.select("doc_id", "page", F.col("line_no").cast("int").alias("line_no"), "text", _thousandths("x0"), _thousandths("x1"), "y", "font_size")


@query
def l2_body_size(spark, d):
    return L.body_size(A.typeset(spark, d)[0])


@query
def l3_margins(spark, d):
    return L.repeated_margins(*A.typeset(spark, d))


@query
def l4_margin_noise(spark, d):
    return L.classify(*A.typeset(spark, d)).where("drop = 'margin'").select("doc_id", "page", "line_no", "text")


@query
def l5_footnotes(spark, d):
    return L.classify(*A.typeset(spark, d)).where("drop = 'footnote'").select("doc_id", "page", "line_no", "text")


@query
def l6_gutters(spark, d):
    lines = L.classify(*A.typeset(spark, d)).where("drop is null")
    return L.gutters(lines).select("doc_id", "page", F.round("gutter", 6).alias("gutter"))


@query
def l7_reading_order(spark, d):
    lines = L.classify(*A.typeset(spark, d)).where("drop is null")
    return L.reading_order(lines).select("doc_id", "page", "line_no", F.col("band").cast("int").alias("band"), "col", F.col("spanning").cast("int").alias("spanning"), "pos")


@query
def l8_block_gaps(spark, d):
    lines = L.classify(*A.typeset(spark, d)).where("drop is null")
    return L.block_gaps(L.reading_order(lines)).select("doc_id", "page", F.col("band").cast("int").alias("band"), "col", "gap")


@query
def l11_paragraphs(spark, d):
    return _flags(D.paragraphs(D.documents(*A.typeset(spark, d))))


@query
def l12_join_lines(spark, d):
    docs = A.read(spark, d, "documents").select("doc_id", F.regexp_replace("text", "([a-z]{4})([a-z]{4})", "$1-\n$2").alias("t"))
    return docs.select("doc_id", F.md5(L.join_lines(F.split("t", "\n")).cast("binary")).alias("joined"))


@query
def l13_stats(spark, d):
    return L.clean_stats(*A.typeset(spark, d))


# --- markup ----------------------------------------------------------------------------------------------------------
@query
def m1_paragraphs(spark, d):
    return _flags(_page_paragraphs(spark, d))


@query
def m2_nav(spark, d):
    return M.nav_entries(_book_files(spark, d, "%nav.xhtml"), F.col("opened"), "doc_id", "opened").drop("opened")


@query
def m3_ncx(spark, d):
    return M.ncx_entries(_book_files(spark, d, "%toc.ncx"), F.col("opened"), "doc_id", "opened").drop("opened")


@query
def m4_toc(spark, d):
    return M.toc(m2_nav(spark, d), m3_ncx(spark, d), "doc_id")


@query
def m6_book_ingest(spark, d):
    made = E.ingest_book_files(A.book_files(spark, d))
    counts = made["chapters"].groupBy("doc_id").agg(F.count("*").alias("chapters"))
    return made["books"].join(counts, "doc_id").select("doc_id", "title", "author", "page_count", "chunk_count", "word_count", "chapters")


@query
def m6_book_chapters(spark, d):
    return E.ingest_book_files(A.book_files(spark, d))["chapters"]


@query
def t8_text_offsets(spark, d):
    return M.text_offsets(M.tokens(A.content_documents(spark, d)), "doc_id")


@query
def m5_toc_chapters(spark, d):
    chunked = _chunks(spark, d)
    sections = chunked.select("doc_id", F.col("page").alias("section"), F.concat(F.lit("s"), F.col("page").cast("string")).alias("path")).distinct()
    toc = sections.select("doc_id", (100 - F.col("section")).alias("seq"), F.concat(F.lit("Part "), F.col("section").cast("string")).alias("title"), F.col("path").alias("href"), F.lit(0).alias("level"))
    return C.toc_chapters(chunked, toc, sections)


# --- sentences, chunks, chapters -------------------------------------------------------------------------------------
@query
def c1_sentences(spark, d):
    return C.sentences(A.paragraphs(spark, d))


@query
def c4_chunks(spark, d):
    return _flags(_chunks(spark, d))


@query
def c2_pack_counts(spark, d):
    return _chunks(spark, d).groupBy("doc_id", "para").agg(F.count("*").alias("pieces"), F.max(F.length("text")).alias("longest"))


@query
def c3_hard_split(spark, d):
    long = C.sentences(A.paragraphs(spark, d)).where(F.length("text") > C.MOST)
    return long.select("doc_id", "para", "sid", F.posexplode(C.hard_split(F.col("text"))).alias("part", "text"))


@query
def c5_chapters(spark, d):
    return C.chapters(_page_chunks(spark, d))


@query
def c6_outline(spark, d):
    chunked = _chunks(spark, d)
    outline = chunked.where("starts_para").select("doc_id", F.col("idx").alias("seq"), F.substring("text", 1, 30).alias("title"), F.when(F.col("idx") % 5 > 0, F.col("page")).alias("page"), F.lit(0).alias("level"))
    return C.outline_chapters(chunked, outline)


@query
def c7_match_title(spark, d):
    return A.paragraphs(spark, d).select("doc_id", "para", T.match_title(F.col("text")).alias("plain"))


@query
def c8_heading_chapters(spark, d):
    return C.heading_chapters(_page_chunks(spark, d))


@query
def c10_word_count(spark, d):
    return _chunks(spark, d).groupBy("doc_id").agg(F.sum(T.count_words(F.col("text"))).alias("words"))


@query
def c11_titles(spark, d):
    return A.properties(spark, d).select("doc_id", T.usable_title(F.col("title")).alias("title"))


@query
def c12_authors(spark, d):
    return A.properties(spark, d).select("doc_id", T.usable_author(F.col("author")).alias("author"))


# --- speech ----------------------------------------------------------------------------------------------------------
def _speech_samples(spark, d):
    """doc_id, text: the conversations as they are, and each with abbreviations, symbols, marks and links after it."""
    talk = A.read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1000).alias("doc_id"), "text", "conv_id", "turn")
    return talk.select("doc_id", "text").union(talk.select((-F.col("doc_id")).alias("doc_id"), F.format_string(A.DECORATED, "text", "conv_id", "turn").alias("text")))


@query
def t1_speak_tokens(spark, d):
    rows = _speech_samples(spark, d).select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("token", "word"))
    return rows.select("doc_id", "token", F.array_join(T.speak_token(F.col("word")), "|").alias("spoken"))


@query
def t4_speech(spark, d):
    said = _speech_samples(spark, d).select("doc_id", T.to_speech(F.col("text")).alias("s"))
    return said.select("doc_id", "s.text", F.array_join(F.transform("s.words", lambda w: F.concat_ws(":", w["offset"].cast("string"), w["token"].cast("string"))), ",").alias("words"))


@query
def t5_token_at(spark, d):
    said = _speech_samples(spark, d).select("doc_id", T.to_speech(F.col("text"))["words"].alias("w"))
    probes = said.select("doc_id", "w", F.explode(F.array(*[F.lit(x) for x in (-1, 0, 7, 40, 10_000)])).alias("at"))
    return probes.select("doc_id", "at", T.token_at_offset(F.col("w"), F.col("at")).alias("token"))


@query
def t6_token_index(spark, d):
    probes = A.read(spark, d, "conversations").select("conv_id", "turn", "text", F.explode(F.array(*[F.lit(x) for x in (-1, 0, 2, 30, 9999)])).alias("at"))
    return probes.select("conv_id", "turn", "at", T.token_index_at(F.col("text"), F.col("at")).alias("token"))


@query
def t7_seconds(spark, d):
    return A.read(spark, d, "documents").select("doc_id", F.round(T.estimate_seconds(T.count_words(F.col("text")), 1.25), 6).alias("seconds"))


# --- narration -------------------------------------------------------------------------------------------------------
@query
def n1_units(spark, d):
    return _flags(N.units(_chunks(spark, d)))


@query
def n2_structural_pauses(spark, d):
    return N.structural_pauses(_page_chunks(spark, d)).select("doc_id", "idx", "pause_ms")


@query
def n3_unit_pauses(spark, d):
    return N.unit_pauses(_chunks(spark, d)).select("doc_id", "chunk_idx", "unit", "pause_ms")


@query
def n4_rates(spark, d):
    return _page_chunks(spark, d).select("doc_id", "idx", F.round(N.unit_rate(F.col("heading"), F.lit(1.25)), 6).alias("rate"))


@query
def n5_successors(spark, d):
    return N.unit_pauses(_chunks(spark, d)).select("doc_id", "chunk_idx", "unit", "next_chunk", "next_unit")


@query
def n6_utterances(spark, d):
    return N.utterances(_page_chunks(spark, d)).select("doc_id", "chunk_idx", "unit", "speech", F.round("rate", 6).alias("rate"), "pause_ms", "cache_key")


@query
def n7_begin(spark, d):
    chunked = _page_chunks(spark, d)
    asks = chunked.select("doc_id", F.col("idx").alias("chunk_idx"), F.explode(F.array(*[F.lit(x) for x in (0, 5, 20, 500)])).alias("token"))
    return N.begin_at(N.units(chunked), asks)


@query
def n8_breath_groups(spark, d):
    return N.utterances(_page_chunks(spark, d)).select("doc_id", "chunk_idx", "unit", F.col("breath_group").cast("int").alias("breath_group"), "queued_behind")


@query
def n10_timeline(spark, d):
    return N.timed(N.timeline(_chunks(spark, d)))


@query
def n11_chunk_at(spark, d):
    times = N.timeline(_chunks(spark, d))
    probes = times.select("doc_id").distinct().select("doc_id", F.explode(F.array(*[F.lit(float(x)) for x in (-5, 0, 30, 100, 100_000)])).alias("seconds"))
    return N.chunk_at(times, probes)


@query
def n12_elapsed(spark, d):
    chunked = _chunks(spark, d)
    return N.elapsed(N.timeline(chunked), chunked.select("doc_id", F.col("idx").alias("chunk_idx"), (F.col("idx") % 11).cast("int").alias("token")), 1.5)


@query
def n13_seek(spark, d):
    last = _chunks(spark, d).groupBy("doc_id").agg(F.max("idx").alias("last"))
    goals = last.select("doc_id", "last", F.explode(F.array(*[F.lit(x) for x in (-3, 2, 9999)])).alias("target"))
    return goals.select("doc_id", "target", N.clamp_seek(F.col("target"), F.col("last")).alias("chunk_idx"), N.clamp_rate(F.col("target") / 2.0).alias("rate"))


@query
def n14_status(spark, d):
    bit = lambda k: F.col("event_id").bitwiseAND(k) > 0
    return A.read(spark, d, "events").select("event_id", N.player_status(bit(1), bit(2), bit(4)).alias("status"))


# --- transcript, bookmarks, library ----------------------------------------------------------------------------------
@query
def q1_transcript(spark, d):
    return B.transcript(_chunks(spark, d), 150).select("doc_id", "idx")


@query
def q2_blocks(spark, d):
    return B.transcript_blocks(_page_chunks(spark, d)).select("doc_id", "idx", F.col("block").cast("int").alias("block"))


def _placed_chunks(spark, d):
    """The chunks that chapters and positions need, made once and written; of a text its start, which gives the title."""
    return S.stored(_page_chunks(spark, d).select("doc_id", "idx", F.substring("text", 1, C.TITLE).alias("text"), "page", "heading"))


@query
def q3_active_chapter(spark, d):
    chunked = _placed_chunks(spark, d)
    return B.active_chapter(C.chapters(chunked), chunked.select("doc_id", F.col("idx").alias("chunk_idx")))


@query
def q4_chapter_step(spark, d):
    chunked = _placed_chunks(spark, d)
    listed = S.stored(C.chapters(chunked))
    return B.chapter_step(B.active_chapter(listed, chunked.select("doc_id", F.col("idx").alias("chunk_idx"))), listed, 1)


def _bookmarks(spark, d):
    return A.positions(spark, d).where("event_type = 'click'").withColumnRenamed("event_id", "id")


@query
def q5_bookmarks(spark, d):
    order = Window.partitionBy("book_id").orderBy("chunk_idx", "token_idx", "id")
    return _bookmarks(spark, d).select("book_id", "id", "chunk_idx", "token_idx", F.row_number().over(order).alias("place"))


@query
def q6_bookmark_here(spark, d):
    here = A.positions(spark, d).where("event_type = 'view'").select("book_id", "chunk_idx", "token_idx").distinct()
    return B.bookmark_here(_bookmarks(spark, d), here)


@query
def q7_excerpts(spark, d):
    chunked = _chunks(spark, d).withColumnRenamed("doc_id", "book_id").withColumnRenamed("idx", "chunk_idx")
    met = _bookmarks(spark, d).join(chunked, ["book_id", "chunk_idx"])
    return met.select("id", T.bookmark_excerpt(F.col("text"), F.col("token_idx")).alias("excerpt"))


@query
def q8_preview(spark, d):
    return A.read(spark, d, "conversations").select("conv_id", "turn", T.preview_sample(F.col("text")).alias("sample"))


def _shelf(spark, d):
    progress = P.progress(A.positions(spark, d))
    return B.shelve(A.books(spark, d), N.timeline(_chunks(spark, d)), progress)


@query
def b1_shelf(spark, d):
    return _flags(_shelf(spark, d))


@query
def b2_reading(spark, d):
    return B.in_scope(_shelf(spark, d), "reading").select("book_id", "fraction")


@query
def b3_search(spark, d):
    return B.search(A.books(spark, d), "EN BOOK 1").select("book_id", "title")


@query
def b4_sorted(spark, d):
    return B.placed(_shelf(spark, d).select("book_id", "remaining_s"), *B.sort_keys("remaining")).select("book_id", "place")


@query
def b5_time_left(spark, d):
    return _shelf(spark, d).select("book_id", T.time_left(F.col("remaining_s")).alias("left"))


@query
def b6_clock(spark, d):
    return A.read(spark, d, "documents").select("doc_id", T.clock(F.col("n_chars") * 3.5 - 20).alias("clock"))


@query
def b7_rate_label(spark, d):
    return A.read(spark, d, "documents").select("doc_id", T.rate_label((F.col("doc_id") % 300) / 100.0).alias("rate"))


@query
def b8_books(spark, d):
    return B.placed(A.books(spark, d).select("book_id", "added_at"), F.desc("added_at"), F.col("book_id")).select("book_id", "place")


@query
def b10_percent(spark, d):
    return _chunks(spark, d).select("doc_id", "idx", B.percent_read(F.col("idx"), F.count("*").over(Window.partitionBy("doc_id"))).alias("percent"))


#: A reader's starred voices; one of them is gone.
STARRED = ["v8", "gone", "v3", "v26"]


# --- voices ----------------------------------------------------------------------------------------------------------
@query
def v1_tiers(spark, d):
    return V.tier(A.voices(spark, d)).select("id", "tier", "rank", V.base_name(F.col("name")).alias("base"))


@query
def v3_usable(spark, d):
    return V.usable(A.voices(spark, d)).select("id")


@query
def v4_best(spark, d):
    return V.best(A.voices(spark, d), "en-US", 4).select("id", "score")


@query
def v5_search(spark, d):
    return V.search(A.voices(spark, d), " EN-").select("id")


@query
def v6_ordered(spark, d):
    return V.ordered(A.voices(spark, d), STARRED, "en-US").select("id", "place")


@query
def v7_shortlist(spark, d):
    return V.shortlist(A.voices(spark, d), STARRED).select("id", "place")


@query
def v8_toggle(spark, d):
    key = F.col("c_custkey")
    stars = F.slice(F.transform(F.sequence(key, key + 6), lambda k: F.concat(F.lit("v"), k.cast("string"))), F.lit(1), (key % 7).cast("int"))
    lists = A.read(spark, d, "customer").select(key, stars.alias("f"), F.concat(F.lit("v"), (key + key % 9).cast("string")).alias("voice"))
    return lists.select("c_custkey", "voice", F.array_join(V.toggle_favourite(F.col("f"), F.col("voice")), ",").alias("after"))


@query
def v9_resolve(spark, d):
    key = F.col("c_custkey")
    named = lambda n: F.concat(F.lit("v"), (n % 150).cast("string"))
    asks = A.read(spark, d, "customer").select(key.alias("n"), F.when(key % 3 > 0, named(key)).alias("book_voice_id"), F.when(key % 4 > 0, named(key * 7)).alias("default_voice_id"))
    return V.resolve(asks, A.voices(spark, d), "en-US").select("n", "voice_id", "source")


@query
def v10_preferred(spark, d):
    return V.preferred(A.voices(spark, d), "en-US")


@query
def v11_picker(spark, d):
    return V.picker(A.voices(spark, d), STARRED, "en-US").select("id", "place")


# --- keyed state and streams -----------------------------------------------------------------------------------------
@query
def k2_cascade(spark, d):
    docs = A.read(spark, d, "documents")
    tables = {
        "books": A.books(spark, d),
        "files": docs.select(F.col("doc_id").alias("book_id"), F.col("text").cast("binary").alias("file")),
        "progress": P.progress(A.positions(spark, d)),
        "bookmarks": _bookmarks(spark, d),
        "audio": _cache(spark, d).union(_cache(spark, d).select(F.concat("key", F.lit("-2")), "blob")),
        "voices": docs.select(F.concat(F.lit("voice:"), F.col("doc_id").cast("string")).alias("key")),
    }
    left = B.delete_books(tables, A.books(spark, d).where("book_id % 10 = 3"))
    key = {"bookmarks": "id", "audio": "key", "voices": "key"}
    parts = [rows.select(F.lit(name).alias("kind"), F.col(key.get(name, "book_id")).cast("string").alias("key")) for name, rows in left.items()]
    return functools.reduce(DataFrame.union, parts)


@query
def k3_progress(spark, d):
    return P.progress(A.positions(spark, d)).select("book_id", "chunk_idx")


@query
def k4_delete_bookmark(spark, d):
    marks = _bookmarks(spark, d)
    return B.delete_keys(marks, marks.where("id % 4 = 0"), "id").select("id", "book_id")


@query
def k5_settings(spark, d):
    key = F.col("c_custkey")
    rate, theme = F.create_map(F.lit("rate"), (key % 5 / 2.0).cast("string")), F.create_map(F.lit("theme"), F.col("c_mktsegment"))
    stored = F.when(key % 3 == 0, rate).when(key % 3 == 1, F.map_concat(rate, theme)).otherwise(F.create_map().cast("map<string,string>"))
    rows = A.read(spark, d, "customer").select("c_custkey", stored.alias("s"))
    return rows.select("c_custkey", F.explode(B.merged_settings(F.col("s"), {"rate": "1", "provider": "system"})).alias("key", "value"))


@query
def k6_book_voices(spark, d):
    key = F.col("c_custkey").cast("string")
    full = F.concat(F.lit('{"voiceId":"v'), key, F.lit('","updatedAt":'), key, F.lit("}"))
    kind = F.col("c_custkey") % 5
    value = F.when(kind == 0, "1").when(kind == 1, F.concat(F.lit('{"voiceId":'), key)).when(kind == 2, F.concat(F.lit('{"updatedAt":'), key, F.lit("}"))).otherwise(full)
    return B.valid_book_voices(A.read(spark, d, "customer").select(F.concat(F.when(kind == 3, "rate:").otherwise("voice:"), key).alias("key"), value.alias("value")))


def _cache(spark, d):
    return A.read(spark, d, "documents").select(F.concat_ws(":", "doc_id", F.lit(0), F.lit(0), F.lit("default")).alias("key"), F.col("text").cast("binary").alias("blob"))


@query
def k8_evict(spark, d):
    return B.evict_audio(_cache(spark, d), "1").select("key")


@query
def k9_audio_bytes(spark, d):
    return B.audio_bytes(_cache(spark, d))


@query
def k11_lookup(spark, d):
    return A.books(spark, d).where("book_id = 7").select("book_id", "title", "author")


def _stream_positions(spark, d):
    n = A.read(spark, d, "documents").count()
    return P.event_stream(spark, d).select((F.col("user_id") % n).alias("book_id"), (F.col("event_id") % 17).cast("int").alias("chunk_idx"), "ts", "event_id", "event_type")


@query
def x1_progress_stream(spark, d):
    return P.drain(P.progress(_stream_positions(spark, d)), S.shared_folder(spark), "complete").select("book_id", "chunk_idx")


@query
def x2_player_stream(spark, d):
    events = P.in_time_order(A.positions(spark, d).drop("token_idx"), S.new_folder(spark, "player"))
    return P.drain(P.player_stream(events), S.shared_folder(spark), "append")


@query
def x2_beats(spark, d):
    asked = N.unit_pauses(_page_chunks(spark, d))
    along = Window.partitionBy("doc_id").orderBy("chunk_idx", "unit")
    ts = F.timestamp_millis(F.lit(1_700_000_000_000) + F.sum(F.col("token_count") * 360 + F.col("pause_ms")).over(along))
    units = S.stored(asked.select("doc_id", "chunk_idx", F.col("unit").cast("int").alias("unit"), "pause_ms", ts.alias("ts")))
    return P.drain(P.beats_stream(P.in_time_order(units, S.new_folder(spark, "beats"))), S.shared_folder(spark), "append").drop("starts_at")


@query
def n9_player_states(spark, d):
    return P.player_states(A.positions(spark, d))


@query
def x4_drop_stale(spark, d):
    rows = A.read(spark, d, "events").select((F.col("user_id") % 20).alias("book_id"), F.col("event_id").alias("seq"), F.floor(F.col("value")).cast("int").alias("session"))
    return P.drop_stale(rows)


@query
def s5_outline(spark, d):
    places = F.explode(F.sequence(F.lit(0), F.lit(11))).alias("node")
    nodes = A.read(spark, d, "documents").select("doc_id", "text", places)
    parent = F.when(F.col("node") >= 3, F.floor(F.col("node") / 3).cast("int") - 1)
    title = F.when(F.col("node") != 1, F.concat(F.lit(" "), F.substring("text", 1, 12))).otherwise(" \n ")
    return O.walk_outline(nodes.select("doc_id", "node", parent.alias("parent"), (20 - F.col("node")).alias("place"), title.alias("title"), F.when(F.col("node") % 4 > 0, F.col("node")).alias("page")))


@query
def n15_rates(spark, d):
    speed = (F.col("doc_id") % 500) / 100.0
    docs = A.read(spark, d, "documents")
    return docs.select("doc_id", F.round(N.web_rate(speed), 6).alias("web"), F.round(N.system_rate(speed), 6).alias("system"))


@query
def q9_details(spark, d):
    lines, pages = A.typeset(spark, d)
    return B.extraction_details(L.clean_stats(lines, pages), _chunks(spark, d), pages)


@query
def k1_save_books(spark, d):
    path, books = S.new_folder(spark, "books"), A.books(spark, d)
    B.save_books(books, path)
    B.save_books(books.where("book_id % 3 = 0").withColumn("title", F.concat("title", F.lit(" (2)"))), path)
    return spark.read.parquet(path).select("book_id", "title", "author", "added_at")


def _split_pages(spark, d, folder):
    """The pages as a stream of files: an early state of every fifth page, then all pages in four files."""
    docs = A.content_documents(spark, d)
    early = docs.where("doc_id % 5 = 0").withColumn("markup", F.concat(F.lit("<h2>Early</h2>"), F.col("markup")))
    early.repartition(1).write.parquet(f"{folder}/source")
    docs.repartitionByRange(4, "doc_id").write.mode("append").parquet(f"{folder}/source")
    return spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/source"), spark.read.parquet(f"{folder}/source").count()


def _ingested(spark, d):
    folder = S.new_folder(spark, "ingest")
    return I.ingest_stream(*_split_pages(spark, d, folder), f"{folder}/table")


@query
def x5_ingest(spark, d):
    return _flags(_ingested(spark, d)["chunks"].select("doc_id", "idx", "text", "page", "para", "starts_para", "heading"))


@query
def x5_progress(spark, d):
    rows = _ingested(spark, d)["progress"]
    return rows.groupBy("stage").agg(F.round(F.max("fraction"), 6).alias("fraction"), F.max("page").alias("page"), F.max("page_count").alias("page_count"))


@query
def x3_highlights(spark, d):
    said = H.spoken_words(_speech_samples(spark, d).withColumn("token_start", F.lit(0)))
    doc = (F.col("event_id") % 150) * 1000 + F.col("event_id") % 9 + 1000
    stream = P.event_stream(spark, d).select("event_id", F.when(F.col("user_id") % 2 == 0, -doc).otherwise(doc).alias("doc_id"), (F.col("event_id") % 401 - 3).cast("int").alias("at"))
    return P.drain(H.highlights(stream, said), S.shared_folder(spark), "append")


@query
def c9_page_ingest(spark, d):
    made = E.ingest_pages(*A.typeset(spark, d))
    counts = made["chapters"].groupBy("doc_id").agg(F.count("*").alias("chapters"))
    return made["books"].join(counts, "doc_id").select("doc_id", "chunk_count", "word_count", "page_count", "chapters", "margin_lines", "footnote_lines", "column_pages")


@query
def c9_page_chunks(spark, d):
    return _flags(E.ingest_pages(*A.typeset(spark, d))["chunks"].select("doc_id", "idx", "text", "page", "para", "starts_para", "heading"))


def _engine(fails: bool) -> Callable:
    """A speech engine that refuses some texts, as long as it fails."""

    def speak(text, voice):
        if fails and len(text) % 7 == 3:
            raise ValueError("refused")
        return f"{voice or 'default'}:{text}".encode()

    return speak


@query
def k7_synthesis(spark, d):
    said, path = S.stored(N.utterances(_page_chunks(spark, d)).select("cache_key", "speech", "voice_id", "unit")), S.new_folder(spark, "audio")
    half = said.where("unit % 2 = 0").select(B.audio_key(F.col("cache_key"), F.col("voice_id")).alias("key"), F.concat(F.lit("old:"), "speech").cast("binary").alias("blob"))
    half.write.parquet(path)
    once = Y.get_or_synthesize(said, path, _engine(True)).select("key", F.col("status").alias("first"), "error")
    again = Y.get_or_synthesize(said, path, _engine(False)).select("key", F.col("status").alias("second"), F.octet_length("blob").alias("bytes"))
    return once.join(again, "key")


@query
def s3_page_scan(spark, d):
    made = K.scan_pages(A.set_pages(spark, d), A.typeset(spark, d)[1], A.properties(spark, d), X.runs)
    return made["pages"].join(made["counts"], ["doc_id", "page"], "left").na.fill(0, ["lines", "chars"]).join(made["about"], "doc_id")


@query
def u1_provider_plans(spark, d):
    told = S.stored(N.spoken_units(_page_chunks(spark, d)))
    engines = [N.Provider(), N.Provider("http", False, False), N.Provider("system", honours_delays=True), N.Provider("plain", True, False, True)]
    plans = [N.planned(told, provider=p).select(F.lit(p.id).alias("provider"), "doc_id", "chunk_idx", "unit", F.col("breath_group").cast("int").alias("breath_group"), "queued_behind", "pre_delay_ms", "timer_ms", "highlight") for p in engines]
    return functools.reduce(DataFrame.union, plans)
