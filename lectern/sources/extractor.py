"""The extractor of typeset pages: inside a task, from a batch of pages with their lines, the boxes of all characters or
the runs of all words as columns, so that no row of one passes between the JVM and Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lectern.functions import arrow as W

#: Characters are 5 wide, spaces 4; a line's text is wider than its font by the leading.
WIDE, SPACE, LEADING = 5.0, 4.0, 1.2


def boxes(batch: pa.RecordBatch) -> dict:
    """The boxes of the characters of `lines`, in the order of the text; page is the batch's row."""
    lists = batch.column("lines")
    lines = lists.flatten()
    offsets, data = W.pieces(lines.field("text"))
    begins = W.starts_of_characters(data)
    at = np.flatnonzero(begins)
    first = W.summed(begins)[offsets]
    line = np.repeat(np.arange(len(lines)), np.diff(first))
    space = data[at] == 32
    blanks = W.summed(space)
    k, before = np.arange(len(at)) - first[line], blanks[:-1] - blanks[first[:-1]][line]
    x0 = W.numbers(lines.field("x0"))[line] + (k * WIDE - before * (WIDE - SPACE))
    size = W.numbers(lines.field("font_size"))
    page = pc.list_parent_indices(lists).to_numpy()[line]
    return {"page": page, "text": W.strings(np.append(at, len(data)), data), "x0": x0, "x1": x0 + np.where(space, SPACE, WIDE), "y": W.numbers(lines.field("y"))[line], "height": (size * LEADING)[line], "font_size": size[line]}


def runs(batch: pa.RecordBatch) -> dict:
    """The runs of the words of `lines`; page is the batch's row."""
    lists = batch.column("lines")
    lines = lists.flatten()
    offsets, data = W.pieces(lines.field("text"))
    space = data == 32
    spaces = np.flatnonzero(space)
    start, end = np.sort(np.concatenate([offsets[:-1], spaces + 1])), np.sort(np.concatenate([spaces, offsets[1:]]))
    words = np.diff(W.summed(space)[offsets]) + 1
    line = np.repeat(np.arange(len(lines)), words)
    k = np.arange(len(line)) - W.summed(words)[:-1][line]
    characters = W.summed(W.starts_of_characters(data))
    x0 = W.numbers(lines.field("x0"))[line] + ((characters[start] - characters[offsets[line]]) * WIDE - k * (WIDE - SPACE))
    page, number = pc.list_parent_indices(lists).to_numpy()[line], lines.field("line_no").to_numpy(zero_copy_only=False)[line]
    text = W.strings(W.summed(end - start), data[~space])
    return {"page": page, "seq": pa.array(number.astype(np.int64) * 1000 + k), "text": text, "x0": pa.array(x0), "x1": pa.array(x0 + (characters[end] - characters[start]) * WIDE), **{c: lines.field(c).take(pa.array(line)) for c in ("y", "font_size")}}
