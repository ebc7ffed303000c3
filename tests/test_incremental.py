"""Incremental ingest and highlights: batches, reruns, updates, progress, and the stream-static lookup."""

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import chunks as C
from lectern.operators import markup as M
from lectern.sources import adapters as A
from lectern.streaming import highlight as H
from lectern.streaming import ingest as I
from lectern.streaming import player as P

SMALL = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns or df.columns).collect()), key=str)


def files(spark, folder, parts):
    for part in parts:
        spark.createDataFrame(part, "doc_id long, markup string").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("doc_id long, markup string").option("maxFilesPerTrigger", 1).parquet(folder)


FIRST = [(1, "<h1>Old</h1><p>Gone soon.</p>"), (2, "<p>Stays as it is. Two sentences.</p>"), (3, "<p>Will be emptied.</p>"), (None, "<p>nobody</p>"), (4, None)]
SECOND = [(1, "<h1>New</h1><p>Here now.</p><p>And more.</p>"), (3, ""), (2, "<p>Stays as it is. Two sentences.</p>"), (2, "<p>A copy that is smaller loses.</p>")]
WANT = [(1, "And more."), (1, "Here now."), (1, "New"), (2, "Stays as it is. Two sentences.")]


def test_batches_replace_reruns_change_nothing_and_progress_is_whole(spark, tmp_path):
    table, told = str(tmp_path / "table"), []
    made = I.ingest_stream(files(spark, str(tmp_path / "in"), [FIRST, SECOND]), 9, table, told.append)
    assert rows(made["chunks"], "doc_id", "text") == WANT
    want = [("reading", 0.0, 0), ("extracting", 0.9 * (5 / 9), 5), ("extracting", 0.9, 9), ("cleaning", 0.92, 9), ("done", 1.0, 9)]
    assert [(r.stage, r.fraction, r.page) for r in made["progress"].orderBy("step").collect()] == want and [t[:3] for t in told] == want
    before = rows(I.current(spark, table))
    I.upsert(spark.createDataFrame(SECOND, "doc_id long, markup string"), 1, table)
    I.upsert(spark.createDataFrame(FIRST, "doc_id long, markup string"), 0, table)
    assert rows(I.current(spark, table)) == before
    assert [r.title for r in made["chapters"].where("doc_id = 1").orderBy("seq").collect()] == ["New"]


def test_goes_on_where_it_ended_and_compacts(spark, tmp_path):
    table, source = str(tmp_path / "table"), str(tmp_path / "in")
    I.ingest_stream(files(spark, source, [FIRST]), 5, table)
    assert rows(I.current(spark, table).select("doc_id").distinct()) == [(1,), (2,), (3,)]
    made = I.ingest_stream(files(spark, source, [SECOND]), 4, table)
    assert rows(made["chunks"], "doc_id", "text") == WANT
    assert [r.fraction for r in made["progress"].orderBy("step").collect()] == [0.0, 0.9, 0.92, 1.0]
    I.compact(spark, table, str(tmp_path / "small"))
    assert rows(I.current(spark, str(tmp_path / "small")), "doc_id", "idx", "text") == rows(made["chunks"], "doc_id", "idx", "text")
    I.upsert(spark.createDataFrame([(2, "<p>Later.</p>")], "doc_id long, markup string"), 7, str(tmp_path / "small"))
    assert rows(I.current(spark, str(tmp_path / "small")).where("doc_id = 2"), "text") == [("Later.",)]


def test_stream_equals_batch_plan(spark, tmp_path):
    docs = A.content_documents(spark, SMALL)
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    made = I.ingest_stream(stream, docs.count(), str(tmp_path / "table"))
    want = C.chunks(M.paragraphs(M.tokens(docs), "doc_id").withColumn("page", F.lit(1)))
    assert rows(made["chunks"], *want.columns) == rows(want) and spark.read.parquet(str(tmp_path / "table/keys")).select("batch").distinct().count() == 3
    assert rows(made["chapters"]) == rows(C.chapters(want))


def test_highlights(spark, tmp_path):
    texts = spark.createDataFrame([(1, "About 5% rain, e.g. today", 10), (2, "", 4), (3, "[7] then", 0)], "doc_id long, text string, token_start int")
    said = {r.doc_id: r.s for r in texts.select("doc_id", T.to_speech(F.col("text")).alias("s")).collect()}
    asks = [(d, at) for d in (1, 2, 3, 9) for at in (-1, 0, 5, 6, 7, 8, 15, 20, 999)] + [(1, None), (None, 3)]

    def want(d, at):
        if d not in said:
            return None
        found = [w.token for w in said[d]["words"] if at is not None and w.offset <= at]
        return {1: 10, 2: 4, 3: 0}[d] + (found[-1] if found else 0)

    table = spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "event_id long, doc_id long, at int")
    found = {r.event_id: r.token for r in H.highlights(table, H.spoken_words(texts)).collect()}
    assert found == {i: want(*a) for i, a in enumerate(asks)}
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed = P.drain(H.highlights(stream, H.spoken_words(texts)), str(tmp_path / "out"), "append")
    assert {r.event_id: r.token for r in streamed.collect()} == found and len(streamed.inputFiles()) >= 3


def test_halving_equals_counting(spark):
    lists = spark.range(40).select(F.expr("transform(slice(sequence(1, 40), 1, cast(id as int)), x -> named_struct('offset', x * 3, 'token', x))").alias("w"))
    probes = lists.select("w", F.explode(F.sequence(F.lit(-2), F.lit(130))).alias("at"))
    wrong = probes.where(T.entries_up_to(F.col("w"), F.col("at"), "offset") != F.size(F.filter("w", lambda x: x["offset"] <= F.col("at"))))
    assert wrong.count() == 0
