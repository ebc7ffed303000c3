"""Glyph boxes to runs: the characters of a page, in the order of its text, cut where one leaves the run so far."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import arrow as W
from lectern.functions import text as T

# How far from a run's first baseline, in its height, a box may stand; how far it may step back and ahead,
# in its own height.
BASELINE, LEAST_BASELINE, BACK, AHEAD = 0.4, 1.0, 0.5, 0.6
#: A box's extent; the texts that are white space.
BOX = ("x0", "x1", "y", "height")
BLANK = re.compile(f"{T.SPACE}*", re.ASCII)
BLANK_BYTES = np.array([BLANK.fullmatch(chr(b)) is not None for b in range(128)] + [False] * 128)


def text_runs(boxes: DataFrame) -> DataFrame:
    """boxes (doc_id, page, seq, text, x0, x1, y, height, font_size), one row each, to the runs of page_runs.

    Pages are packed first, which sorts a row for each character; a source that has its boxes page by page gives them
    to page_runs as they are.
    """
    box = F.struct("seq", "text", *[F.col(c).cast("double").alias(c) for c in BOX], F.coalesce(F.col("font_size").cast("double"), F.lit(0.0)).alias("font_size"))
    return page_runs(boxes.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(box)).alias("boxes")))


def page_runs(pages: DataFrame, boxes: Callable[[pa.RecordBatch], dict] | None = None) -> DataFrame:
    """pages (doc_id, page, boxes), boxes being an array of (text, x0, x1, y, height, font_size) in the order of the text,
    to runs (doc_id, page, seq, text, x0, x1, y, font_size), without a shuffle.

    A source that has its boxes inside the task gives a function from a batch of its pages, whose texts lie in lists
    named lines, to columns of boxes, with page, the batch's row; then no box passes between the JVM and Python.

    White space and boxes without a finite extent end a run and are dropped. Any other box goes on with the run if it
    stands on its first baseline, within the run's height so far, and next to its right edge so far. A run's size is the
    greatest declared one, else its height.
    """
    kinds = pages.schema
    schema = f"doc_id {kinds['doc_id'].dataType.simpleString()}, page {kinds['page'].dataType.simpleString()}, seq int, text string, x0 double, x1 double, y double, font_size double"
    held, read = ("boxes", _held_boxes) if boxes is None else ("lines", boxes)

    def runs(batches):
        for batch in batches:
            for part in W.parts(batch, held):
                yield _runs(part, **read(part))

    return pages.select("doc_id", "page", held).mapInArrow(runs, schema)


def _held_boxes(batch: pa.RecordBatch) -> dict:
    lists = batch.column("boxes")
    boxes = lists.flatten()
    size = pc.fill_null(boxes.field("font_size").cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    return {"page": pc.list_parent_indices(lists).to_numpy(), "text": boxes.field("text"), **{c: W.numbers(boxes.field(c)) for c in BOX}, "font_size": size}


def _blank(text: pa.Array, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which texts are null, empty or white space."""
    wide = np.diff(offsets)
    blank, one = wide == 0, wide == 1
    blank[one] = BLANK_BYTES[data[offsets[:-1][one]]]
    more = np.flatnonzero(wide > 1)
    words = text.take(pa.array(more)).dictionary_encode()
    kinds = np.array([BLANK.fullmatch(w) is not None for w in words.dictionary.to_pylist()], bool)
    blank[more] = kinds[words.indices.to_numpy()]
    return blank


def _runs(batch: pa.RecordBatch, page, text, x0, x1, y, height, font_size) -> pa.RecordBatch:
    offsets, data = W.pieces(text)
    wide, tall = np.diff(offsets), height
    inked = ~_blank(text, offsets, data) & np.isfinite(x0) & np.isfinite(x1) & np.isfinite(y) & np.isfinite(tall) & (tall > 0) & (x1 >= x0)
    at = np.flatnonzero(inked)
    page, x0, x1, y, tall, size = (c[at] for c in (page, x0, x1, y, tall, font_size))
    parted = np.ones(len(at), bool)
    parted[1:] = (np.diff(at) > 1) | (np.diff(page) > 0)
    first = np.flatnonzero(_begins(parted, x0, x1, y, tall))
    # the boxes of a run lie side by side, and so do the bytes of their texts
    joined = W.strings(W.summed(wide[at])[np.append(first, len(at))], data[np.repeat(inked, wide)])
    of = page[first]
    seq = np.arange(len(first)) - np.searchsorted(of, of)
    least, most, declared, high = (f.reduceat(c, first) if len(first) else c for f, c in ((np.minimum, x0), (np.maximum, x1), (np.maximum, size), (np.maximum, tall)))
    declared = np.where((declared > 0) | np.isnan(declared), declared, high)
    keys = [batch.column(c).take(pa.array(of)) for c in ("doc_id", "page")]
    return pa.record_batch([*keys, pa.array(seq, pa.int32()), joined, *[pa.array(c, pa.float64()) for c in (least, most, y[first], declared)]], ["doc_id", "page", "seq", "text", "x0", "x1", "y", "font_size"])


def _begins(parted, x0, x1, y, tall):
    """Which boxes begin a run. No run goes over a parted box.

    In a part of one baseline and height whose right edges never step back, a box's neighbour is its run so far.
    """
    begins = parted.copy()
    starts = np.flatnonzero(parted)
    if not len(starts):
        return begins
    alike, fresh = parted.copy(), np.zeros(len(parted), bool)
    alike[1:] |= (y[1:] == y[:-1]) & (tall[1:] == tall[:-1]) & (x1[1:] >= x1[:-1])
    fresh[1:] = ~((x0[1:] >= x1[:-1] - tall[1:] * BACK) & (x0[1:] - x1[:-1] < tall[1:] * AHEAD))
    even = np.logical_and.reduceat(alike, starts)
    lengths = np.diff(np.append(starts, len(parted)))
    begins |= fresh & np.repeat(even, lengths)
    _follow(begins, starts[~even], lengths[~even], x0, x1, y, tall)
    return begins


def _follow(begins, starts, lengths, x0, x1, y, tall):
    """Marks in begins the boxes of the other parts that begin a run: all parts advance together, a box a round, each
    with its run's first baseline, height and right edge so far."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    base, high, right = y[starts], tall[starts], x1[starts]
    for k in range(1, lengths[0] if len(lengths) else 0):
        n = np.searchsorted(-lengths, -k, "left")  # the parts that have more than k boxes
        i = starts[:n] + k
        b, h, r = base[:n], high[:n], right[:n]
        near = np.abs(y[i] - b) <= np.maximum(LEAST_BASELINE, h * BASELINE)
        fresh = ~(near & (x0[i] >= r - tall[i] * BACK) & (x0[i] - r < tall[i] * AHEAD))
        begins[i] = fresh
        base[:n] = np.where(fresh, y[i], b)
        high[:n] = np.where(fresh, tall[i], np.maximum(h, tall[i]))
        right[:n] = np.where(fresh, x1[i], np.maximum(r, x1[i]))
