import random
import zipfile

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunks as C
from lectern.operators import layout as L
from lectern.operators import library as B
from lectern.operators import markup as M
from lectern.operators import outline as O
from lectern.operators import schedule as N
from lectern.operators import voices as V
from lectern.plans import ingest, synthesis
from lectern.sources import adapters as A
from lectern.sources import archives as Z
from lectern.sources import pages as K
from lectern.streaming import player as P

SMALL = "/root/testdata/sf0.001"


def lines(spark, rows):
    data = [(0, r.get("page", 1), i, r["text"], float(r.get("x0", 72)), float(r.get("x1", 540)), float(r["y"]), float(r.get("size", 11))) for i, r in enumerate(rows)]
    made = spark.createDataFrame(data, "doc_id long, page int, line_no int, text string, x0 double, x1 double, y double, font_size double")
    pages = made.select("doc_id", "page").distinct().withColumn("width", F.lit(612.0)).withColumn("height", F.lit(792.0))
    return made, pages


def paras(spark, rows):
    return [(r["text"], r["heading"]) for r in L.paragraphs(*lines(spark, rows)).orderBy("para").collect()]


def test_golden_counts(spark):
    p = A.paragraphs(spark, SMALL)
    chunked = C.chunks(p).cache()
    assert (p.count(), C.sentences(p).count(), chunked.count()) == (1829, 6988, 2782)
    assert chunked.agg(F.sum(T.count_words(F.col("text"))), F.max(F.length("text"))).first()[:] == (79047, 480)
    pages = M.paragraphs(M.tokens(A.content_documents(spark, SMALL)), "doc_id").withColumn("page", F.lit(1))
    assert (pages.count(), pages.where("heading").count(), C.chunks(pages).count()) == (569, 50, 794)


def test_chunks_keep_all_text(spark):
    p = A.paragraphs(spark, SMALL)
    joined = C.chunks(p).groupBy("doc_id", "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("t"))
    assert p.join(joined, ["doc_id", "para"]).where(F.col("text") != F.col("t")).count() == 0


def test_group_lines_from_random_geometry(spark):
    """Rows of words with gaps of every kind: glued below a fifth of the size, spaced, or apart from 3.5 sizes on."""
    pick, data, want = random.Random(2), [], []
    for page in range(20):
        seq = 0
        for row in range(5):
            size, x, text = pick.choice([8.0, 10.0, 12.0]), 40.0, ""
            for k in range(pick.randrange(1, 9)):
                gap = 0.0 if k == 0 else pick.choice([0.0, size * 0.1, size * 0.5, size * 3.0, size * 4.0])
                word = pick.choice(["reed", "moor", "tarn", "fell", "x"])
                if k and gap >= size * 3.5:
                    want.append((page, text))
                    text = word
                else:
                    text += " " * (gap > size * 0.2) + word
                data.append((0, page, seq, word, x + gap, x + gap + 20, 700.0 - 20 * row, size))
                x, seq = x + gap + 20, seq + 1
            want.append((page, text))
    made = spark.createDataFrame(data, "doc_id long, page int, seq int, text string, x0 double, x1 double, y double, font_size double")
    assert [(r["page"], r["text"]) for r in L.group_lines(made).orderBy("page", "line_no").collect()] == want


def test_columns_and_spanning_title(spark):
    left = [{"text": f"Left {i} goes on", "x0": 60, "x1": 290, "y": 700 - 15 * i} for i in range(4)]
    right = [{"text": f"right {i} goes on", "x0": 320, "x1": 550, "y": 700 - 15 * i} for i in range(4)]
    made, pages = lines(spark, [v for pair in zip(left, right) for v in pair])
    got = [r["text"] for r in L.reading_order(made.join(pages, ["doc_id", "page"])).orderBy("pos").collect()]
    assert got == [x["text"] for x in left + right]
    title = {"text": "A Title", "x0": 100, "x1": 500, "y": 730}
    made, pages = lines(spark, [v for pair in zip(left, right) for v in pair] + [title])
    assert L.reading_order(made.join(pages, ["doc_id", "page"])).orderBy("pos").first()["text"] == "A Title"


def test_page_breaks_headings_indents_hyphens(spark):
    for head, tail in (("it drif-", "ted off"), ("it drif‐", "ted off"), ("see page A-", "7 below"), ("from Low-", "Water quay")):
        joined = head[:-1] + tail if tail[0].islower() else f"{head} {tail}"
        assert paras(spark, [{"text": head, "y": 610}, {"text": tail, "y": 595}]) == [(joined, False)]
    assert paras(spark, [{"text": "First one", "y": 700}, {"text": "Second one", "y": 685, "x0": 95}]) == [("First one", False), ("Second one", False)]
    assert paras(spark, [{"text": "Chapter 1", "y": 720, "x1": 130}, {"text": "It was a day", "y": 690}]) == [("Chapter 1", True), ("It was a day", False)]
    assert paras(spark, [{"text": "runs on", "y": 100}, {"text": "to the next", "y": 700, "page": 2}]) == [("runs on to the next", False)]


def test_noise(spark):
    rows = []
    for n in range(1, 5):
        rows += [{"text": "The Salt Road", "y": 752, "page": n}, {"text": f"Body of page {n} is here", "y": 500, "page": n}, {"text": "a note", "y": 120, "size": 7, "page": n}, {"text": str(n), "y": 30, "page": n}]
    stats = L.clean_stats(*lines(spark, rows)).first()
    assert (stats["margin_lines"], stats["footnote_lines"], stats["body"]) == (8, 4, 11.0)


def chunk_rows(spark, rows):
    return spark.createDataFrame([(0, i, t, p, i, s, h) for i, (t, p, s, h) in enumerate(rows)], "doc_id long, idx int, text string, page int, para int, starts_para boolean, heading boolean")


def test_chapters_from_outline_and_headings(spark):
    made = chunk_rows(spark, [("Front matter", 1, True, False), ("Chapter One", 3, True, True), ("text", 3, True, False), ("Chapter Two", 9, True, True), ("more", 9, True, False)])
    outline = spark.createDataFrame([(0, 0, "Chapter One", 3, 0), (0, 1, "Chapter Two", 9, 0), (0, 2, "Lost", None, 0)], "doc_id long, seq int, title string, page int, level int")
    want = [("Beginning", 0), ("Chapter One", 1), ("Chapter Two", 3)]
    for given in (outline, None):
        assert [(r["title"], r["chunk_idx"]) for r in C.chapters(made, given).orderBy("seq").collect()] == want


def test_markup_tokens(spark):
    text = """<!DOCTYPE html><!-- <p>no</p> --><p title="a > b">One &amp;lt; &#65;&#x42; &bogus; <![CDATA[<raw> &amp;]]></p><br/><dc:Title>T</dc:Title><broken"""
    rows = M.tokens(spark.createDataFrame([(0, text)], "doc_id long, markup string")).orderBy("pos").collect()
    assert [(r["kind"], r["name"]) for r in rows] == [("open", "p"), ("text", None), ("text", None), ("close", "p"), ("open", "br"), ("open", "title"), ("text", None), ("close", "title"), ("text", None)]
    assert rows[0]["attrs"] == {"title": "a > b"} and rows[4]["self_closing"]
    assert rows[1]["text"] == "One &lt; AB &bogus; " and rows[2]["text"] == "<raw> &amp;" and rows[-1]["text"] == "<broken"


def test_content_paragraphs(spark):
    text = "<html><head><title>x</title></head><body><h1>Head</h1><p>One<br/>two</p><table><p>no</p></table><p>three</p><script>var a='</p>'</script></body></html>"
    rows = M.paragraphs(M.tokens(spark.createDataFrame([(0, text)], "doc_id long, markup string")), "doc_id").orderBy("para").collect()
    assert [(r["text"], r["heading"]) for r in rows] == [("Head", True), ("One two", False), ("three", False)]


def test_clamped_depth_is_sequential(spark):
    r = random.Random(5)
    data = [(d, i, r.choice((-1, 0, 1))) for d in range(40) for i in range(30)]
    rows = M.clamped(spark.createDataFrame(data, "doc_id long, pos int, step int"), F.col("step"), "depth", "doc_id").orderBy("doc_id", "pos").collect()
    depth = {}
    for x in rows:
        depth[x["doc_id"]] = max(0, depth.get(x["doc_id"], 0) + x["step"])
        assert x["depth"] == depth[x["doc_id"]]


def test_epub_archives_give_what_their_files_give(spark, tmp_path):
    """Books of the given pages, zipped: the ingest of archives equals that of their files."""
    files = A.book_files(spark, SMALL).where("doc_id < 3").collect()
    for doc in {f["doc_id"] for f in files}:
        with zipfile.ZipFile(tmp_path / f"{doc}.epub", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
            for f in files:
                if f["doc_id"] == doc:
                    z.writestr(f["name"], f["markup"])
    (tmp_path / "broken.epub").write_bytes(b"not a zip")
    made = ingest.ingest_epub(Z.read_files(spark, str(tmp_path)))
    want = ingest.ingest_book_files(A.book_files(spark, SMALL).where("doc_id < 3"))
    number = F.regexp_extract("doc_id", r"(\d+)\.epub$", 1).cast("long")
    for name in ("chunks", "chapters", "books"):
        one, two = made[name].withColumn("doc_id", number), want[name]
        assert sorted(map(tuple, one.select(*two.columns).collect()), key=str) == sorted(map(tuple, two.collect()), key=str) and two.count() >= 3


def test_a_book_without_contents_has_its_headings(spark):
    opf = '<package><metadata/><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="c"/><itemref idref="b"/><itemref idref="a"/></spine></package>'
    files = [("META-INF/container.xml", '<container><rootfile full-path="x.opf"/></container>'), ("x.opf", opf), ("a.xhtml", "<h1>Last</h1><p>End.</p>"), ("c.xhtml", "<p>Start here.</p>")]
    made = ingest.ingest_book_files(spark.createDataFrame([(5, *f) for f in files] + [(6, "stray.txt", "no book")], "doc_id long, name string, markup string"))
    assert [(r["text"], r["page"]) for r in made["chunks"].orderBy("idx").collect()] == [("Start here.", 1), ("Last", 3), ("End.", 3)]
    assert [(r["title"], r["chunk_idx"]) for r in made["chapters"].orderBy("seq").collect()] == [("Beginning", 0), ("Last", 1)]
    assert [(r["title"], r["page_count"]) for r in made["books"].collect()] == [("5", 3)]


def test_pauses_and_groups(spark):
    made = chunk_rows(spark, [("One here. Two here.", 1, True, False), ("This one is split,", 1, True, False), ("and ends here.", 1, False, False), ("Next para.", 1, True, False), ("Chapter 2", 1, True, True)])
    got = [(r["chunk_idx"], r["unit"], r["pause_ms"]) for r in N.unit_pauses(made).orderBy("chunk_idx", "unit").collect()]
    assert got == [(0, 0, 0), (0, 1, 220), (1, 0, 460), (2, 0, 0), (3, 0, 460), (4, 0, 900)]
    assert [r["breath_group"] for r in N.utterances(made).orderBy("chunk_idx", "unit").collect()] == [0, 1, 2, 2, 3, 4]
    start = N.begin_at(N.units(made), spark.createDataFrame([(0, 0, 3), (0, 0, 99)], "doc_id long, chunk_idx int, token int")).orderBy("token").collect()
    assert [(r["unit"], r["dropped"], r["rest"]) for r in start] == [(1, 1, "here."), (1, 0, "Two here.")]


def test_silent_units_leave_their_pause(spark):
    made = chunk_rows(spark, [("One.", 1, True, False), ("[4]", 1, True, False), ("Two.", 1, False, False)])
    assert [(r["chunk_idx"], r["pause_ms"]) for r in N.utterances(made).orderBy("chunk_idx").collect()] == [(0, 0), (2, 460)]


def test_timeline(spark):
    made = chunk_rows(spark, [(" ".join(["w"] * 165), 1, True, False)] * 3)
    times = N.timeline(made)
    assert [(r["start_s"], r["duration_s"]) for r in N.timed(times).orderBy("chunk_idx").collect()] == [(0.0, 60.0), (60.0, 60.0), (120.0, 60.0)]
    probes = spark.createDataFrame([(0, s) for s in (-4.0, 0.0, 59.9, 60.0, 1e6)], "doc_id long, seconds double")
    assert [r["chunk_idx"] for r in N.chunk_at(times, probes).orderBy("seconds").collect()] == [0, 0, 0, 1, 2]


def test_voices(spark):
    voices = A.voices(spark, "/root/testdata/sf0.01")
    jokes = {r["id"] for r in voices.where(F.col("name").isin(A.JOKES)).collect()}
    kept = V.usable(voices).collect()
    assert jokes and not jokes & {r["id"] for r in kept} and len({(V_base(r["name"]), r["lang"].lower()) for r in kept}) == len(kept)
    stars = ["v9", "none", "v2"]
    assert [r["id"] for r in V.shortlist(voices, stars).orderBy("place").collect()] == ["v9", "v2"]
    assert [r["id"] for r in V.ordered(voices, stars, "en-US").orderBy("place").limit(2).collect()] == ["v9", "v2"]
    asks = spark.createDataFrame([("x", "y"), (None, "y")], "book_voice_id string, default_voice_id string")
    assert sorted((r["voice_id"], r["source"]) for r in V.resolve(asks, voices.where("false"), "en-US").collect()) == [("x", "book"), ("y", "default")]


def V_base(name):
    return name.lower().replace(" (premium)", "").replace(" (enhanced)", "").replace(" (compact)", "")


def test_library(spark):
    books = spark.createDataFrame([(0, "T", None), (1, "U", "Ann")], "book_id long, title string, author string")
    times = N.timeline(chunk_rows(spark, [("a b", 1, True, False), ("c d", 1, True, False)]))
    shelf = B.shelve(books, times, spark.createDataFrame([(0, 99)], "book_id long, chunk_idx int")).orderBy("book_id").collect()
    assert (shelf[0]["started"], shelf[0]["finished"], shelf[0]["fraction"]) == (True, True, 0.5)
    assert (shelf[1]["started"], shelf[1]["finished"], shelf[1]["fraction"]) == (False, False, 0.0)
    assert B.search(books, "u ann").count() == 1


def test_synthesis_runs_each_key_once(spark):
    made = spark.createDataFrame([("1:0:0", "hi", None), ("1:0:0", "hi", None), ("1:0:2", "yo", "v")], "cache_key string, speech string, voice_id string")
    cache = spark.createDataFrame([("1:0:2:v", b"old")], "key string, blob binary")
    got = {r["key"]: bytes(r["blob"]) for r in synthesis.synthesize(made, cache, lambda text, voice: text.encode()).collect()}
    assert got == {"1:0:2:v": b"old", "1:0:0:default": b"hi"}


def test_stream_equals_table(spark, tmp_path):
    events = A.positions(spark, SMALL)
    n = A.read(spark, SMALL, "documents").count()
    stream = P.event_stream(spark, SMALL).select((F.col("user_id") % n).alias("book_id"), (F.col("event_id") % 17).cast("int").alias("chunk_idx"), "ts", "event_id", "event_type")
    assert sorted(map(tuple, P.drain(P.progress(stream), str(tmp_path), "complete").collect())) == sorted(map(tuple, P.progress(events).collect()))


def test_placed_numbers_every_row_once(spark):
    rows = spark.range(997).select(F.pmod(F.xxhash64("id"), F.lit(50)).alias("key"), F.col("id").alias("book_id"))
    got = [(r["key"], r["book_id"]) for r in B.placed(rows, F.desc("key"), F.col("book_id")).orderBy("place").collect()]
    assert got == sorted(got, key=lambda r: (-r[0], r[1])) and len(got) == 997


def test_engine_rates(spark):
    row = spark.range(1).select(*[N.system_rate(F.lit(x)).alias(f"s{i}") for i, x in enumerate((0.1, 0.5, 1.0, 2.0, 9.0))], N.web_rate(F.lit(9.0)).alias("w")).first()
    assert tuple(row) == (0.25, 0.25, 0.5, 0.75, 1.0, 4.0)


def test_outline_keeps_what_stands_under_a_blank_title(spark):
    nodes = spark.createDataFrame([(1, 1, None, 0, " One ", 3), (1, 2, 1, 0, " ", 4), (1, 3, 2, 0, "Deep\n down", None), (1, 4, None, 1, "Two", 9), (1, 5, 99, 0, "lost", 1)], "doc_id long, node int, parent int, place int, title string, page int")
    got = [tuple(r) for r in O.walk_outline(nodes).orderBy("seq").collect()]
    assert got == [(1, 0, "One", 3, 0), (1, 1, "Deep down", None, 2), (1, 2, "Two", 9, 0)]


def test_provider_flags_steer_the_plan(spark):
    made = chunk_rows(spark, [("One. Two", 1, True, False), ("and goes on.", 1, False, False), ("[3]", 1, True, False), ("Next para.", 1, False, False)])

    def plan(**flags):
        rows = N.utterances(made, provider=N.Provider("x", **flags)).orderBy("chunk_idx", "unit").collect()
        return [(r["pre_delay_ms"], r["timer_ms"], r["queued_behind"], r["breath_group"]) for r in rows], {r["highlight"] for r in rows}

    # a beat before "Two", none before its continuation, and the silent paragraph leaves its pause to the next
    assert plan() == ([(0, 0, 0, 0), (0, 220, 0, 1), (0, 0, 1, 1), (0, 460, 0, 2)], {"word"})
    assert plan(supports_boundaries=False, supports_queueing=False) == ([(0, 0, 0, 0), (0, 220, 0, 1), (0, 0, 0, 2), (0, 460, 0, 3)], {"unit"})
    assert plan(honours_delays=True) == ([(0, 0, 0, 0), (220, 0, 1, 0), (0, 0, 2, 0), (460, 0, 3, 0)], {"word"})
    assert plan(supports_queueing=False, honours_delays=True)[0] == plan(supports_queueing=False)[0]


def test_page_scan(spark):
    runs = spark.createDataFrame([(1, 1, 0, "Reeds", 10.0, 40.0, 700.0, 10.0), (1, 1, 1, None, 0.0, 0.0, 0.0, 1.0), (1, 1, 2, "bend", 44.0, 60.0, 700.0, 10.0), (1, 9, 0, "off", 1.0, 2.0, 3.0, 4.0)], "doc_id long, page int, seq int, text string, x0 double, x1 double, y double, font_size double")
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0), (1, 2, 595.0, 842.0), (2, 1, 100.0, 100.0)], "doc_id long, page int, width double, height double")
    made = K.scan(runs, pages, spark.createDataFrame([(1, " The Bend \n", " \t"), (3, "x", "y")], "doc_id long, title string, author string"))
    assert [(r["page"], r["text"], r["x1"]) for r in made["lines"].collect()] == [(1, "Reeds bend", 60.0)]
    assert sorted(map(tuple, made["about"].collect())) == [(1, "The Bend", None, 2), (2, "", None, 1)]
    assert made["pages"].count() == 3
