"""Glyph boxes to runs, against the rule box by box, and outlines of any depth."""

import random

from lectern.operators import glyphs as G
from lectern.operators import layout as L
from lectern.operators import outline as O
from lectern.sources import adapters as A

SMALL = "/root/testdata/sf0.001"
BOX = "doc_id long, page int, seq int, text string, x0 double, x1 double, y double, height double, font_size double"


def brute(boxes):
    """One page's runs: a box at a time, with the run so far at hand."""
    out, run = [], []
    for _, _, _, text, x0, x1, y, h, size in sorted(boxes, key=lambda b: b[2]):
        good = None not in (x0, x1, y, h) and all(abs(v) < float("inf") for v in (x0, x1, y, h)) and h > 0 and x1 >= x0
        if not good or text is None or not text.strip():
            out, run = out + [run] * bool(run), []
            continue
        if run:
            tall, right = max(b[4] for b in run), max(b[2] for b in run)
            if not (abs(y - run[0][3]) <= max(1.0, tall * 0.4) and x0 >= right - h * 0.5 and x0 - right < h * 0.6):
                out, run = out + [run], []
        run = run + [(text, x0, x1, y, h, size or 0.0)]
    out += [run] * bool(run)
    return [("".join(b[0] for b in r), min(b[1] for b in r), max(b[2] for b in r), r[0][3], max(b[5] for b in r) or max(b[4] for b in r)) for r in out]


def runs(spark, boxes):
    return [tuple(r) for r in G.text_runs(spark.createDataFrame(boxes, BOX)).orderBy("doc_id", "page", "seq").select("text", "x0", "x1", "y", "font_size").collect()]


def test_a_run_is_measured_as_a_whole(spark):
    def page(*chars):
        return [(1, 1, i, c, float(x), float(x + 5), float(y), float(h), size) for i, (c, x, y, h, size) in enumerate(chars)]

    raised = page(("x", 0, 100, 10, 11.0), ("2", 5, 103, 6, 7.0), ("y", 10, 100, 10, 11.0))
    assert runs(spark, raised) == [("x2y", 0.0, 15.0, 100.0, 11.0)]  # each box against the first baseline
    creeping = page(*[(c, 5 * i, 100 + 2 * i, 10, 0.0) for i, c in enumerate("abcd")])
    assert [r[0] for r in runs(spark, creeping)] == ["abc", "d"]  # near the box before is not enough
    wide = [(1, 1, 0, "W", 0.0, 30.0, 100.0, 10.0, None), (1, 1, 1, "i", 26.0, 28.0, 100.0, 10.0, None), (1, 1, 2, "j", 34.0, 36.0, 100.0, 10.0, None)]
    assert runs(spark, wide) == [("Wij", 0.0, 36.0, 100.0, 10.0)]  # the right edge is the widest so far
    assert [r[0] for r in runs(spark, page(("a", 0, 0, 10, 1.0), (" ", 5, 0, 10, 1.0), ("b", 6, 0, 10, 1.0), ("c", 18, 0, 10, 1.0)))] == ["a", "b", "c"]


def test_random_pages_equal_the_rule(spark):
    pick = random.Random(8)
    boxes = []
    for page in range(60):
        x = 0.0
        for i in range(pick.randrange(0, 40)):
            x += pick.choice([0, 4, 5, 5, 5, 9, -3, -8])
            h = pick.choice([0.0, 6.0, 10.0, 10.0, 14.0])
            row = [page % 3, page, i, pick.choice(["a", "b", "é", " ", " ", "", None]), x, x + pick.choice([5.0, 2.0, -1.0]), pick.choice([100.0, 100.0, 102.0, 105.0]), h, pick.choice([None, 0.0, 11.0])]
            if pick.random() < 0.05:
                row[4 + pick.randrange(4)] = pick.choice([None, float("inf"), float("nan")])
            boxes.append(tuple(row))
    want = [r for key in sorted({(b[0], b[1]) for b in boxes}) for r in brute([b for b in boxes if (b[0], b[1]) == key])]
    assert runs(spark, boxes) == want


def test_lines_of_boxes_equal_lines_of_words(spark):
    columns = ["doc_id", "page", "line_no", "text", "x0", "x1", "y", "font_size"]
    one = L.group_lines(G.text_runs(A.glyph_boxes(spark, SMALL).where("doc_id < 25"))).select(*columns).collect()
    two = L.group_lines(A.glyph_runs(spark, SMALL).where("doc_id < 25")).select(*columns).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(one) > 300


def test_no_boxes(spark):
    assert G.text_runs(spark.createDataFrame([], BOX)).count() == 0


def test_deep_outline(spark):
    deep = [(1, i, i - 1 if i else None, 0, f"t{i}", i) for i in range(200)]
    cycle = [(1, 900, 901, 0, "round", 1), (1, 901, 900, 0, "and round", 1), (1, 902, 900, 0, "below", 1)]
    orphans = [(1, 910, 555, 0, "lost", 1), (1, 911, 910, 0, "lost too", 1), (2, 5, None, 3, "other", 1), (2, 6, None, 1, "first", None)]
    nodes = spark.createDataFrame(deep + cycle + orphans, "doc_id long, node int, parent int, place int, title string, page int")
    got = [tuple(r) for r in O.walk_outline(nodes).orderBy("doc_id", "seq").collect()]
    assert got == [(1, i, f"t{i}", i, i) for i in range(200)] + [(2, 0, "first", None, 0), (2, 1, "other", 1, 0)]
    assert O.walk_outline(nodes.where("false")).count() == 0


def test_random_outlines_equal_recursion(spark):
    pick = random.Random(3)
    nodes = [(d, i, pick.choice([None, *range(max(0, i - 4), i)]) if i else None, pick.randrange(3), pick.choice(["a", "b ", " "]), None) for d in range(20) for i in range(30)]

    def walk(d, parent, level):
        for _, node, _, _, title, _ in sorted((n for n in nodes if n[0] == d and n[2] == parent), key=lambda n: (n[3], n[1])):
            if title.strip():
                yield (title.strip(), level)
            yield from walk(d, node, level + 1)

    made = O.walk_outline(spark.createDataFrame(nodes, "doc_id long, node int, parent int, place int, title string, page int"))
    got = [tuple(r) for r in made.orderBy("doc_id", "seq").select("doc_id", "title", "level").collect()]
    assert got == [(d, *entry) for d in range(20) for entry in walk(d, None, 0)]


def brute_lines(runs):
    """One page's lines: a run at a time, with the line so far at hand."""
    lines, last = [], None
    for _, _, _, text, x0, x1, y, size in sorted((r for r in runs if r[3]), key=lambda r: (-r[6], r[4], r[2])):
        gap = x0 - last if lines else 0.0
        if lines and abs(lines[-1][3] - y) <= max(1.5, size * 0.4) and gap < size * 3.5:
            before = lines[-1]
            space = " " if gap > size * 0.2 and not before[0][-1].isspace() and not text[0].isspace() else ""
            lines[-1] = (before[0] + space + text, before[1], max(before[2], x1), before[3], max(before[4], size))
        else:
            lines.append((text, x0, x1, y, size))
        last = x1
    squashed = [(" ".join(n[0].split()), *n[1:]) for n in lines]
    return [n for n in squashed if n[0]]


def test_lines_of_random_runs_equal_the_rule(spark):
    pick = random.Random(4)
    made = []
    for page in range(80):
        x = 0.0
        for i in range(pick.randrange(0, 40)):
            x += pick.choice([0, 4, 5, 9, 12, 40, -30])
            made.append((page % 3, page, i, pick.choice(["a", "bc", "\u00e9", "a ", " b", "", " ", "two words", "\u3000y", None]), x, x + pick.choice([5.0, 11.0, -1.0]), pick.choice([100.0, 100.0, 101.0, 102.5, 105.0, 90.0]), pick.choice([6.0, 10.0, 10.0, 14.0])))
    pages = sorted({(r[0], r[1]) for r in made})
    want = [(*key, i, *n) for key in pages for i, n in enumerate(brute_lines([r for r in made if r[:2] == key]))]
    pick.shuffle(made)
    got = L.group_lines(spark.createDataFrame(made, "doc_id long, page int, seq int, text string, x0 double, x1 double, y double, font_size double"))
    assert [tuple(r) for r in got.orderBy("doc_id", "page", "line_no").collect()] == want
    holed = spark.createDataFrame([(1, 1, 0, "a", None, 5.0, 9.0, 10.0), (1, 1, 1, "b", 6.0, None, 9.0, 10.0), (1, 1, 2, "c", 12.0, 17.0, 9.0, None), (1, 1, 3, "d", 17.0, 20.0, 9.0, 8.0)], "doc_id long, page int, seq int, text string, x0 double, x1 double, y double, font_size double")
    assert [(r["text"], r["x1"]) for r in L.group_lines(holed).orderBy("line_no").collect()] == [("ab", 5.0), ("cd", 20.0)]  # nulls end a line, and are no greatest value
