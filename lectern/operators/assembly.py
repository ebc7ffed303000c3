"""Positioned lines to the paragraphs of whole documents in one pass: the rules of layout.classify, arranged and assembled
on the columns of a batch of documents, so that no line moves once its document is put together."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import arrow as W
from lectern.operators import layout as L

PARAGRAPH = "struct<text:string,page:int,heading:boolean>"
COUNTS = ("margin_lines", "footnote_lines", "column_pages", "page_count")
PAGE_NUMBER, HEADING_WORDS, DIGITS = re.compile(L.PAGE_NUMBER, re.ASCII), re.compile(L.HEADING_WORDS, re.ASCII), re.compile("[0-9]+")
LINE_END = re.compile(L.LINE_END[:-1] + "\u0085?\\Z")


def documents(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines (doc_id, page, line_no, text, x0, x1, y, font_size) and pages (doc_id, page, width, height) to a row for each
    document that has a line on a listed page: doc_id, paragraphs (text, page, heading), body, margin_lines,
    footnote_lines, column_pages, page_count.

    Lines that are dealt by doc_id already do not move; pages, which are few, meet them by document.
    """
    line = F.struct(F.col("page").cast("int").alias("page"), F.col("line_no").cast("int").alias("line_no"), "text", *[F.col(c).cast("double").alias(c) for c in ("x0", "x1", "y", "font_size")])
    page = F.struct(F.col("page").cast("int").alias("page"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"))
    whole = lines.groupBy("doc_id").agg(F.collect_list(line).alias("lines"))
    listed = pages.groupBy("doc_id").agg(F.collect_list(page).alias("pages"))
    schema = f"doc_id {lines.schema['doc_id'].dataType.simpleString()}, paragraphs array<{PARAGRAPH}>, body double, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return whole.join(listed.hint("shuffle_hash"), "doc_id").select("doc_id", "lines", "pages").mapInArrow(_read, schema)


def paragraphs(made: DataFrame) -> DataFrame:
    """doc_id, para, text, page, heading of documents."""
    return made.select("doc_id", F.posexplode("paragraphs").alias("para", "p")).select("doc_id", "para", "p.*")


def _read(batches):
    for batch in batches:
        for part in W.parts(batch, "lines"):
            yield _documents(part)


def _documents(batch: pa.RecordBatch) -> pa.RecordBatch:
    held, body = _judged(batch)
    of = held["doc"][held["listed"]]
    count = lambda rows: np.bincount(rows, minlength=batch.num_rows)
    margin, footnote = (count(held["doc"][held[c]]) for c in ("margin", "footnote"))
    kept = _take(held, np.flatnonzero(held["listed"] & ~held["margin"] & ~held["footnote"]))
    rows, columns = _arranged(kept)
    made = _assembled(rows, body, batch.num_rows)
    page_count = pc.list_value_length(batch.column("pages")).to_numpy(zero_copy_only=False)
    out = pa.record_batch([batch.column("doc_id"), made, pa.array(body, pa.float64(), from_pandas=True), *[pa.array(c.astype(np.int64)) for c in (margin, footnote, count(columns), page_count)]], ["doc_id", "paragraphs", "body", *COUNTS])
    return out.filter(pa.array(count(of) > 0))


def _take(rows: dict, at: np.ndarray) -> dict:
    return {c: v.take(pa.array(at)) if isinstance(v, pa.Array) else v[at] for c, v in rows.items()}


def _same(*columns: np.ndarray) -> np.ndarray:
    """Which rows equal the row before in all columns."""
    same = np.zeros(len(columns[0]), bool)
    if len(same):
        same[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return same


def _distinct(text: pa.Array, rule) -> np.ndarray:
    """The rule on each text; it is asked once for equal ones."""
    words = text.dictionary_encode()
    return np.array([rule(w) for w in words.dictionary.to_pylist()], bool)[words.indices.to_numpy()]


def _judged(batch: pa.RecordBatch) -> tuple[dict, np.ndarray]:
    """The lines with what classify finds, and the body size of each document, NaN where it has none."""
    lists, listed = batch.column("lines"), batch.column("pages")
    lines, pages = lists.flatten(), listed.flatten()
    text = pc.fill_null(lines.field("text"), "")
    offsets, data = W.pieces(text)
    length = np.diff(W.summed(W.starts_of_characters(data))[offsets])
    doc, owner = pc.list_parent_indices(lists).to_numpy(), pc.list_parent_indices(listed).to_numpy()
    number = lambda rows, c: rows.field(c).to_numpy(zero_copy_only=False).astype(np.int64)
    held = {"doc": doc, "page": number(lines, "page"), "line_no": number(lines, "line_no"), "text": text, "length": length, **{c: W.numbers(lines.field(c)) for c in ("x0", "x1", "y", "font_size")}}

    # the size of each line's page
    key = lambda d, p: (d.astype(np.int64) << 32) + p
    known = key(owner, number(pages, "page"))
    order = np.argsort(known, kind="stable")
    asked = key(doc, held["page"])
    place = np.minimum(np.searchsorted(known[order], asked), max(len(known) - 1, 0))
    held["listed"] = known[order][place] == asked if len(known) else np.zeros(len(doc), bool)
    for c in ("width", "height"):
        held[c] = W.numbers(pages.field(c))[order][place] if len(known) else np.full(len(doc), np.nan)

    # the upper median size, each line weighted by its length
    weight = np.maximum(1, np.floor(length / 10 + 0.5)).astype(np.int64)
    body = np.full(batch.num_rows, np.nan)
    size = held["font_size"]
    order = np.lexsort([np.where(np.isnan(size), -np.inf, size), doc])
    before = W.summed(weight[order])
    start = np.searchsorted(doc[order], np.arange(batch.num_rows))
    total = before[np.searchsorted(doc[order], np.arange(batch.num_rows), "right")] - before[start]
    upper = np.flatnonzero((before[1:] - before[start][doc[order]] > total[doc[order]] // 2) & ~np.isnan(size[order]))[::-1]
    body[doc[order][upper]] = size[order][upper]  # the first of a document is written last

    y, height, top = held["y"], held["height"], held["listed"]
    edge = top & ((y > height * L.TOP) | (y < height * L.BOTTOM))
    margin = np.zeros(len(doc), bool)
    at = np.flatnonzero(edge)
    if len(at):
        shown = text.take(pa.array(at)).dictionary_encode()
        plain = L._squashed(pa.array([DIGITS.sub("#", w.lower()) for w in shown.dictionary.to_pylist()], pa.string())).dictionary_encode()
        of = plain.indices.to_numpy()[shown.indices.to_numpy()].astype(np.int64)
        blank = np.array([w == "" for w in plain.dictionary.to_pylist()], bool)[of]
        n = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
        least = np.where(n <= 4, 2, np.maximum(3, np.ceil(n * 0.25)))
        seen = np.unique(np.stack([doc[at], of, held["page"][at]]), axis=1)
        pairs, on = np.unique(key(seen[0], seen[1]), return_counts=True)
        often = pairs[on >= least[(pairs >> 32)]]
        margin[at] = (np.isin(key(doc[at], of), often) & ~blank) | _distinct(text.take(pa.array(at)), lambda w: PAGE_NUMBER.search(w) is not None)
    held["margin"] = margin
    held["footnote"] = top & ~margin & (size <= body[doc] * L.FOOTNOTE_SIZE) & (y < height * L.FOOTNOTE_ZONE)
    return held, body


def _arranged(kept: dict) -> tuple[dict, np.ndarray]:
    """The kept lines in reading order with leaf, a number for each page, page_width, spanning, band and col; and the
    documents of the pages that have columns, each as often as it has one."""
    order = np.lexsort([kept["line_no"], kept["x0"], -kept["y"], kept["page"], kept["doc"]])
    rows = _take(kept, order)
    first = np.flatnonzero(~_same(rows["doc"], rows["page"]))
    rows["leaf"] = leaf = np.cumsum(~_same(rows["doc"], rows["page"])) - 1
    if not len(first):
        return rows | {"page_width": rows["x0"], "spanning": rows["listed"], "band": leaf, "col": leaf}, rows["doc"]
    x0, x1, width = rows["x0"], rows["x1"], rows["width"]
    rows["page_width"] = (np.maximum.reduceat(x1, first) - np.minimum.reduceat(x0, first))[leaf]

    # a line crosses the candidates right of its start up to its end, and lies left of those after
    fractions = np.array(L.gutter_fractions())
    low, high = np.zeros(len(leaf), np.int64), np.zeros(len(leaf), np.int64)
    for f in fractions:
        low += width * f <= x0
        high += width * f < x1
    low = np.minimum(low, high)
    many, wide = len(first), len(fractions) + 1
    ended, begun = (np.bincount(leaf * wide + e, minlength=many * wide).reshape(many, wide)[:, :-1] for e in (high, low))
    left, n = ended.cumsum(1), np.bincount(leaf)[:, None]
    crossings = begun.cumsum(1) - left
    balance = np.minimum(left, n - crossings - left) / n
    best = np.where(crossings == crossings.min(1, keepdims=True), -balance, np.inf).argmin(1)[:, None]
    least, most = (np.take_along_axis(v, best, 1)[:, 0] for v in (crossings, balance))
    parted = (n[:, 0] >= L.COLUMN_LINES) & (least / n[:, 0] <= L.CROSSING_MOST) & (most >= L.BALANCE_LEAST)
    gutter = np.where(parted, width[first] * fractions[best[:, 0]], np.nan)[leaf]

    rows["spanning"] = spanning = (x0 < gutter) & (x1 > gutter)
    turn = np.zeros(len(leaf), np.int64)
    turn[1:] = (spanning[1:] != spanning[:-1]) & (leaf[1:] == leaf[:-1])
    rows["band"] = np.cumsum(turn)  # on from page to page
    rows["col"] = (~np.isnan(gutter) & ~spanning & ~(x1 <= gutter)).astype(np.int64)
    rows = _take(rows, np.lexsort([np.arange(len(leaf)), rows["col"], rows["band"], leaf]))
    blocks = ~_same(rows["leaf"], rows["band"], rows["col"])
    columns = (np.bincount(rows["leaf"], blocks) > 1) | (np.maximum.reduceat(rows["col"], first) > 0)
    return rows, rows["doc"][first][columns]


def _line_ends(offsets: np.ndarray, data: np.ndarray, text: pa.Array) -> np.ndarray:
    """Which texts end a sentence."""
    padded = np.concatenate([np.zeros(2, np.uint8), data])
    last, second = padded[offsets[1:] + 1], padded[offsets[1:]]
    wide = np.diff(offsets)
    mark = lambda b: (b == ord(".")) | (b == ord("!")) | (b == ord("?"))
    ends = ((wide > 0) & mark(last)) | ((wide > 1) & mark(second) & np.isin(last, np.frombuffer(b"\"')]", np.uint8)))
    odd = np.flatnonzero((wide > 1) & (last == 0x85))
    ends[odd] = _distinct(text.take(pa.array(odd)), lambda w: LINE_END.search(w) is not None)
    return ends


def _assembled(rows: dict, body: np.ndarray, documents: int) -> pa.Array:
    """The paragraphs of arranged lines, a list for each document."""
    doc, text = rows["doc"], rows["text"]
    offsets, data = W.pieces(text)
    x0, x1, y = rows["x0"], rows["x1"], rows["y"]
    block = np.cumsum(~_same(rows["leaf"], rows["band"], rows["col"])) - 1
    first = np.flatnonzero(~_same(block))
    if not len(first):
        empty = pa.StructArray.from_arrays([pa.array([], pa.string()), pa.array([], pa.int32()), pa.array([], pa.bool_())], ["text", "page", "heading"])
        return pa.ListArray.from_arrays(pa.array(np.zeros(documents + 1), pa.int32()), empty)
    i = np.arange(len(doc)) - first[block]
    left, right = np.minimum.reduceat(x0, first)[block], np.maximum.reduceat(x1, first)[block]
    wide = np.maximum(right - left, 1.0)
    # the upper median of a block's positive line distances
    down = np.zeros(len(doc))
    down[1:] = y[:-1] - y[1:]
    stepped = np.flatnonzero((i > 0) & (down > 0))
    stepped = stepped[np.lexsort([down[stepped], block[stepped]])]
    count = np.bincount(block[stepped], minlength=len(first))
    gap = np.zeros(len(first))
    gap[count > 0] = down[stepped][(W.summed(count)[:-1] + count // 2)[count > 0]]
    gap = gap[block]

    ends = _line_ends(offsets, data, text)
    short = rows["length"] <= L.HEADING_CHARS
    named = np.zeros(len(doc), bool)
    at = np.flatnonzero(short & pc.match_substring_regex(text, "^(?i:chapter|part|section|appendix|prologue|epilogue)").to_numpy(zero_copy_only=False))
    named[at] = _distinct(text.take(pa.array(at)), lambda w: HEADING_WORDS.search(w) is not None)
    big = (rows["font_size"] >= body[doc] * L.HEADING_SIZE) & (x1 - x0 < rows["page_width"] * L.HEADING_WIDTH) & ~ends
    heading = short & (named | big)

    lag = lambda v: np.concatenate([v[:1], v[:-1]])
    step = x0 - left
    indented = (step > wide * L.INDENT[0]) & (step < wide * L.INDENT[1])
    inside = ((gap > 0) & (lag(y) - y > gap * L.GAP)) | (lag(ends) & (lag(x1) < right - wide * L.RAGGED))
    across = lag(x1) < lag(right) - lag(wide) * L.RAGGED
    begins = ~_same(doc) | heading | lag(heading) | ((i == 0) & (rows["spanning"] | lag(rows["spanning"]))) | indented | np.where(i > 0, inside, across)
    starts = np.flatnonzero(begins)
    joined = _joined(text, begins)
    shown = pc.not_equal(joined, "")
    columns = [c.filter(shown) for c in (joined, pa.array(rows["page"][starts], pa.int32()), pa.array(np.logical_or.reduceat(heading, starts)))]
    counts = np.bincount(doc[starts][shown.to_numpy(zero_copy_only=False)], minlength=documents)
    return pa.ListArray.from_arrays(pa.array(W.summed(counts), pa.int32()), pa.StructArray.from_arrays(columns, ["text", "page", "heading"]))


def _joined(text: pa.Array, begins: np.ndarray) -> pa.Array:
    """Lines joined by spaces from one that begins to the next; blank ones are left out, and a hyphen before a
    lower-case letter at a line's start goes with the break."""
    offsets, data = W.pieces(L._squashed(text))
    paragraph = np.cumsum(begins) - 1
    kept = np.flatnonzero(np.diff(offsets) > 0)
    of, start, end = paragraph[kept], offsets[:-1][kept].astype(np.int64), offsets[1:][kept].astype(np.int64)
    going_on = np.zeros(len(kept), bool)  # the next line is of the same paragraph
    going_on[:-1] = of[1:] == of[:-1]
    padded = np.concatenate([np.zeros(2, np.uint8), data])
    last, second, third = padded[end + 1], padded[end], padded[end - 1]
    dash = (end - start >= 3) & (third == 0xE2) & (second == 0x80) & (last >= 0x90) & (last <= 0x94)
    low = np.zeros(len(kept), bool)
    low[:-1] = (data[start[1:]] >= ord("a")) & (data[start[1:]] <= ord("z"))
    cut = going_on & low & ((last == ord("-")) | dash)
    # each line gives its bytes without such a hyphen, and a space where it goes on without one
    taken = end - start - np.where(cut, np.where(dash, 3, 1), 0)
    given = taken + (going_on & ~cut)
    at = W.summed(given)
    out = np.full(at[-1], 32, np.uint8)
    inner = np.arange(taken.sum()) - np.repeat(W.summed(taken)[:-1], taken)
    out[np.repeat(at[:-1], taken) + inner] = data[np.repeat(start, taken) + inner]
    return W.strings(at[np.searchsorted(of, np.arange(begins.sum() + 1))], out)
