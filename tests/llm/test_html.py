"""Page extraction: the reader, the field against enumeration, held-out pages, and the given pages."""

import itertools
import math
import re
from html import unescape

import numpy as np
import pytest

from lectern.llm import html, html_samples
from lectern.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def field(spark):
    return html.train(html_samples.labelled_pages(spark))


def main_text(page, field):
    blocks = html.leaf_blocks(page)
    return "\n".join(t for (_, t, _), y in zip(blocks, field.label(blocks)) if y)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>one<p>two</p>three", ["one", "two", "three"]),
        ("<p><b>a<br>b<p>c", ["a b", "c"]),
        ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]),
        ("<p>R&amp;D &lt;b&gt; &eacute;&#233;&#xE9; &copy 1 &amp", ["R&D <b> ééé © 1 &"]),
        ("<title>no</title><head><title>t</title></head><body>yes", ["yes"]),
        ("<script>var a='</p><p>no';</script>yes<style>p{}</style><textarea>no</textarea>", ["yes"]),
        ("<script>never closed <p>no", []),
        ("a<!-- <p>no --> b<!-->c<!--d", ["a bc"]),
        ("<p title=\"a>b\">in</p><p title='x' data-x=don't>it's", ["in", "it's"]),
        ("<p>cut <foot", ["cut"]),
        ("1 < 2 and 3 > 2 <3", ["1 < 2 and 3 > 2 <3"]),
        ("<p>a \n\t b</p>", ["a b"]),
        ("<td>a<td>b<tr><td>c", ["a", "b", "c"]),
        ("", []),
    ],
)
def test_leaf_blocks(page, want):
    assert [t for _, t, _ in html.leaf_blocks(page)] == want


def test_open_elements_and_links():
    found = html.leaf_blocks('<div class="mainMenu Side-bars"><ul><li><a href=x>go</a> on</ul></div><article id=c><p>t</article>x')
    assert [([t for t, _ in path], text, linked) for path, text, linked in found] == [(["div", "ul", "li"], "go on", 2), (["article", "p"], "t", 0), ([], "x", 0)]
    assert found[0][0][0] == ("div", ("bar", "main", "menu", "side"))


def test_deep_and_long_pages():
    deep = html.leaf_blocks("<div>" * 20_000 + "x" + "</div>" * 20_000 + "</i>" * 20_000)
    assert [t for _, t, _ in deep] == ["x"] and len(deep[0][0]) == 64
    assert len(html.leaf_blocks("<a \"'<p " * 20_000 + "<p>" + "word " * 200_000)) <= 20_001


def chances(emit, steps):
    """Scores of all labellings of one page, by enumeration."""
    out = {}
    for y in itertools.product((0, 1), repeat=len(emit)):
        out[y] = sum(e for e, k in zip(emit, y) if k) + sum(steps[a][b] for a, b in zip(y, y[1:]))
    return out


def test_field_equals_enumeration():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 8):
        emit, steps = rng.normal(size=n), rng.normal(size=(2, 2))
        scores = chances(emit, steps)
        assert tuple(html.Field({}, steps.tolist()).decode(emit.tolist())) == max(scores, key=scores.get)
        whole = math.log(sum(map(math.exp, scores.values())))
        y = rng.integers(0, 2, n)
        padded, labels = np.zeros((2, 9)), np.zeros((2, 9), np.int64)
        padded[:, :n], labels[:, :n] = emit, y
        value, by_emit, by_step = html.likelihood(padded, steps, labels, np.array([n, n]))
        assert value == pytest.approx(2 * (scores[tuple(y)] - whole))
        share = {k: math.exp(v - whole) for k, v in scores.items()}
        want = [y[i] - sum(p for k, p in share.items() if k[i]) for i in range(n)]
        assert by_emit[0, :n] == pytest.approx(want) and not by_emit[:, n:].any()
        pairs = [[2 * (sum(a == i and b == j for a, b in zip(y, y[1:])) - sum(p * sum(a == i and b == j for a, b in zip(k, k[1:])) for k, p in share.items())) for j in (0, 1)] for i in (0, 1)]
        assert by_step == pytest.approx(np.array(pairs))


def test_held_out_pages(field):
    """Pages of other seeds: nearly all blocks right, most pages whole."""
    right = blocks_right = blocks = 0
    for page in html_samples.pages(300, seed=11):
        found, labels = html.marked_blocks(page)
        got = field.label(found)
        right += got == labels
        blocks += len(labels)
        blocks_right += sum(a == b for a, b in zip(got, labels))
    assert blocks_right / blocks > 0.985 and right > 0.88 * 300


LAYOUTS = [
    '<body><header><a href="/">Site</a><nav><a href=a>One</a> <a href=b>Two</a></nav></header><div class="cookie-notice">We use cookies. <button>OK</button></div><main><article>{0}</article><section id="comments"><h2>Comments</h2><div class="comment"><p>{1}</p></div></section></main><aside class="sidebar"><h3>More</h3><ul><li><a href=x>{2}</a></li></ul></aside><footer>&copy; 2020 Site</footer></body>',
    '<body><div id="header"><h2>Site</h2></div><ul class="menu"><li><a href=a>One</a><li><a href=b>Two</a></ul><div class="post-content">{0}</div><div class="advert">{1}</div><form class="newsletter"><p>{2}</p><input></form><div class="footer">Legal</div></body>',
    '<html><body><div class="ads"><p>{1}</p></div><div class="entry-content">{0}<div class="share-buttons">Share</div></div><div class="widget related"><h4>Related</h4><p>{2}</p></div></body></html>',
    '<html><body><nav><ul><li><a href=x>{2}</a></li></ul></nav><article><header><h1>T</h1></header>{0}<aside class="promo">{1}</aside></article><ol class="comment-list"><li class="comment">{2}</li></ol></body></html>',
]


@pytest.mark.parametrize("layout", range(len(LAYOUTS)))
def test_layouts_written_by_hand(field, layout):
    own = html_samples.Page(900 + layout)
    paragraphs = [own.sentences(2, 5) for _ in range(6)]
    inner = "".join(f"<p>{t}</p>" for t in paragraphs)
    page = LAYOUTS[layout].format(inner, own.sentences(1, 3), own.sentences(1, 2))
    assert main_text(page, field) == "\n".join(["T"] * (layout == 3) + paragraphs)


def article(page):
    """The text of the given pages' article, by cutting it out."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    if "</article>" not in page:
        inner = re.sub(r"<[^>]*\Z", "", inner)
    parts = [" ".join(unescape(re.sub(r"<[^>]+>", lambda m: " " if m[0] == "<br>" else "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(p for p in parts if p)


def test_given_pages(spark):
    want = {r.page_id: (r.url, article(r.html), len(article(r.html))) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in Q.op11_extraction(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_awkward_rows(spark, field):
    page = LAYOUTS[0].format("<p>" + "Words of the long story, as told. " * 30 + "</p>", "no", "no")
    rows = [(1, "u", None), (2, None, ""), (None, "u", page), (None, "u", page), (3, "u", "plain < text"), (4, "u", "<article><p>" + "long text. " * 300_000)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(table, field).collect()
    assert [(r.page_id, r.url) for r in got] == [r[:2] for r in rows]
    assert [r.text for r in got[:2]] == ["", ""] and got[2] == got[3] and got[2].text.startswith("Words of the long")
    assert got[5].n_chars == len("long text. " * 300_000) - 1
    assert html.extract(table.where("page_id < 0"), field).count() == 0
    assert html.extract(table.drop("url"), field).where("url is null").count() == len(rows)
    nothing = html.train(spark.createDataFrame([(None,), ("",)], "html string"))
    assert html.extract(table, nothing).where("text <> ''").count() == 0


def test_repeatable(spark):
    one, two = (html.train(rows) for rows in (html_samples.labelled_pages(spark, 60), html_samples.labelled_pages(spark, 60).orderBy("html")))
    assert one.weights == two.weights and one.steps == two.steps and len(one.weights) > 50
