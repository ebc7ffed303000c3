"""What keeps the work in proportion to the input: how often a text is cut, and what is sorted or sent."""

import pyarrow as pa
from pyspark.sql import functions as F

from lectern import queries as Q
from lectern.functions import arrow as W
from lectern.functions import text as T
from lectern.operators import glyphs as G
from lectern.operators import layout as L
from lectern.operators import schedule as N
from lectern.sources import adapters as A
from lectern.sources import extractor as X

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_cut_once_into_sentences(spark):
    made = A.read(spark, SMALL, "documents").select(T.sentences(F.col("text")).alias("s"))
    assert plan(made).count("split(text#") == 1


def test_units_and_lines_need_no_window(spark):
    chunked = spark.createDataFrame([(1, 0, "One two. Three four five.")], "doc_id long, idx int, text string")
    assert "Window" not in plan(N.units(chunked))
    assert [tuple(r) for r in N.units(chunked).select("unit", "token_start", "token_count").collect()] == [(0, 0, 2), (1, 2, 3)]
    assert "Window" not in plan(A.typeset(spark, SMALL)[0]) + plan(A.paragraphs(spark, SMALL))


def test_listed_pages_are_those_that_hold_a_line(spark):
    lines, pages = A.typeset(spark, SMALL)
    assert sorted(map(tuple, pages.collect())) == sorted(map(tuple, A.pages_of(lines).collect()))


def test_lines_are_read_once_to_judge_their_document(spark):
    lines, pages = A.typeset(spark, SMALL)
    assert plan(L.classify(lines, pages)).count("Relation [") <= 5
    judged = {r["doc_id"]: r for r in L._judgement(lines, pages).collect()}
    assert {d: r["body"] for d, r in judged.items()} == {r["doc_id"]: r["body"] for r in L.body_size(lines).collect()}
    assert {(d, k) for d, r in judged.items() for k in r["keys"]} == set(map(tuple, L.repeated_margins(lines, pages).collect()))


def test_characters_and_words_are_not_sorted_to_meet_on_their_page(spark):
    for name, most in (("s4_glyph_runs", 2), ("l1_group_lines", 3)):  # the explodes: typeset has two, the lines of a page are a third
        assert plan(Q.REGISTRY[name](spark, SMALL)).count("Generate ") == most
    scanned = plan(Q.REGISTRY["s3_page_scan"](spark, SMALL))
    assert "LeftSemi" not in scanned and "Window" not in scanned


def test_pages_of_boxes_and_runs_hold_the_rows(spark):
    def rows(df):
        return sorted(map(tuple, df.collect()), key=repr)

    few = "doc_id < 12"
    assert rows(G.page_runs(A.glyph_pages(spark, SMALL).where(few))) == rows(G.text_runs(A.glyph_boxes(spark, SMALL).where(few)))
    assert rows(L.page_lines(A.run_pages(spark, SMALL).where(few))) == rows(L.group_lines(A.glyph_runs(spark, SMALL).where(few)))
    assert G.page_runs(A.glyph_pages(spark, SMALL).where("false")).count() == 0


def test_chunks_and_speech_are_made_once(spark):
    for name in ("q3_active_chapter", "q4_chapter_step"):
        assert "regexp_extract_all" not in plan(Q.REGISTRY[name](spark, SMALL))  # markup is not cut again for each reader
    assert "lambda" not in plan(Q.REGISTRY["u1_provider_plans"](spark, SMALL))  # nor speech made again for each engine


def test_arranged_lines_move_once_to_become_paragraphs(spark):
    made = spark.createDataFrame([(1, 1, 0, "One line.", 60.0, 140.0, 700.0, 11.0, 11.0, 0, 0, False, 0, 80.0)], "doc_id long, page int, line_no int, text string, x0 double, x1 double, y double, font_size double, body double, band int, col int, spanning boolean, pos int, page_width double")
    assert "Join" not in plan(L.assembled(made)) and plan(L.assembled(made)).count("Repartition") == 1
    assert [(r["doc_id"], r["para"], r["text"]) for r in L.assembled(made).collect()] == [(1, 0, "One line.")]


def test_no_character_or_word_passes_between_the_jvm_and_python(spark):
    for name, column in (("s4_glyph_runs", "boxes"), ("s3_page_scan", "runs"), ("l1_group_lines", "runs")):
        made = plan(Q.REGISTRY[name](spark, SMALL))
        assert "MapInArrow" in made and f"{column}#" not in made


def test_no_line_moves_to_be_counted(spark):
    assert "Generate posexplode(lines" not in plan(Q.REGISTRY["s3_page_scan"](spark, SMALL))


def test_the_extractor_gives_the_rows_of_boxes_and_runs(spark):
    def rows(df):
        return sorted(map(tuple, df.collect()), key=repr)

    few = "doc_id < 12"
    set_ = A.set_pages(spark, SMALL).where(few)
    assert rows(G.page_runs(set_, X.boxes)) == rows(G.text_runs(A.glyph_boxes(spark, SMALL).where(few)))
    assert rows(L.page_lines(set_, X.runs)) == rows(L.group_lines(A.glyph_runs(spark, SMALL).where(few)))
    assert G.page_runs(set_.where("false"), X.boxes).count() == L.page_lines(set_.where("false"), X.runs).count() == 0


def test_a_batch_is_worked_on_in_parts_of_bounded_size():
    lists = [["é" * 10], [], ["a" * 5, "b" * 5], ["c" * 100], None, ["d"]]
    batch = pa.record_batch({"n": range(6), "lines": pa.array([x if x is None else [{"text": t} for t in x] for x in lists], pa.list_(pa.struct({"text": pa.string()})))})
    made = list(W.parts(batch.slice(1), "lines", 12))
    assert [p.column("n").to_pylist() for p in made] == [[1, 2], [3], [4, 5]]


def test_white_space_is_squashed_alike(spark):
    odd = ["a", "a b", " a", "a ", "a  b", "a\tb", "a b", "a b", "a \u0085", "﻿a", "— é", "", "a　", " "]
    made = spark.createDataFrame([(t,) for t in odd], "t string").select(F.transform(F.array("t"), T.squash_bound)[0], T.squash(F.col("t")))
    assert all(a == b for a, b in made.collect()) and made.count() == len(odd)
