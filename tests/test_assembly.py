"""Whole documents in one pass, against the operators line by line."""

import random

from lectern.functions import storage as S
from lectern.operators import assembly as D
from lectern.operators import chunks as C
from lectern.operators import layout as L
from lectern.sources import adapters as A

SMALL = "/root/testdata/sf0.001"
LINE = "doc_id long, page int, line_no int, text string, x0 double, x1 double, y double, font_size double"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect() if columns else df.collect()), key=repr)


def agree(lines, pages):
    made, para = D.documents(lines, pages), ("doc_id", "para", "text", "page", "heading")
    ordered = L.arranged(L.classify(lines, pages))
    found = rows(D.paragraphs(made), *para)
    assert found == rows(L.assembled(ordered), *para)
    stats = ("doc_id", "body", "margin_lines", "footnote_lines", "column_pages")
    assert rows(made, *stats) == rows(L.clean_stats(lines, pages), *stats)
    return found


def test_random_documents_equal_the_operators(spark):
    pick = random.Random(11)
    words = ["one", "Two", "three-", "four—", "end.", 'said."', "Chapter", "chapters", "(five)", "é!", "-", "12", "vii", "page", "two  wide", " ", "x\u0085"]
    lines, pages = [], []
    for doc in range(60):
        count = pick.randrange(1, 8)
        for page in range(1, count + 1):
            if pick.random() < 0.95:
                pages.append((doc, page, pick.choice([612.0, 612.0, 500.0]), 792.0))
            columns, y = pick.random() < 0.5, [740.0, 740.0]
            shown = [("Running Head" if doc % 2 else f"Head {page}", 72.0, 200.0, 750.0, 9.0), (f"Page {page}", 290.0, 320.0, 30.0, 9.0)] * (doc % 5 != 0)
            for _ in range(pick.randrange(0, 30)):
                side = pick.randrange(2) if columns and pick.random() < 0.95 else 0
                y[side] -= pick.choice([14.0, 14.0, 14.0, 20.0, 30.0])
                x0 = (320.0 if side else 60.0) + pick.choice([0.0, 0.0, 0.0, 14.0])
                x1 = x0 + pick.choice([230.0, 230.0, 230.0, 150.0] if columns and pick.random() < 0.97 else [480.0, 300.0])
                shown.append((" ".join(pick.choice(words) for _ in range(pick.choice([1, 2, 5, 9]))), x0, x1, y[side], pick.choice([11.0, 11.0, 11.0, 14.0, 7.0])))
            lines += [(doc, page, i, *line) for i, line in enumerate(shown)]
    pick.shuffle(lines)
    found = agree(S.stored(spark.createDataFrame(lines, LINE)), spark.createDataFrame(pages, "doc_id long, page int, width double, height double"))
    assert len(found) > 300 and any(r[4] for r in found)


def test_typeset_documents_equal_the_operators(spark):
    lines, pages = A.typeset(spark, SMALL)
    assert len(agree(S.stored(lines.where("doc_id < 60")), S.stored(pages.where("doc_id < 60")))) > 100


def test_no_lines_and_no_pages(spark):
    lines, pages = spark.createDataFrame([(1, 1, 0, "Text.", 60.0, 100.0, 700.0, 11.0)], LINE), spark.createDataFrame([(1, 2, 612.0, 792.0), (3, 1, 612.0, 792.0)], "doc_id long, page int, width double, height double")
    assert D.documents(lines, pages).count() == 0 and D.documents(lines.where("false"), pages).count() == 0
    assert D.documents(lines, pages.where("false")).count() == 0


def test_chunks_of_documents_equal_those_of_paragraphs(spark):
    made = S.stored(D.documents(*A.typeset(spark, SMALL)))
    assert rows(C.document_chunks(made), "doc_id", "idx", "text", "page", "para", "starts_para", "heading") == rows(C.chunks(D.paragraphs(made)), "doc_id", "idx", "text", "page", "para", "starts_para", "heading")


def test_lines_do_not_move_once_they_are_dealt(spark):
    made = C.document_chunks(D.documents(*A.typeset(spark, SMALL)))
    executed = made._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange ") == 2 and executed.count("REPARTITION_BY_COL") == 2  # whole documents, for lines and for pages
    assert "Window" not in executed
