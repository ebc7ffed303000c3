"""Page layout: glyph runs to lines, reading order, and lines to paragraphs."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import arrow as W
from lectern.functions import text as T

# The layout rules' thresholds.
COLUMN_GAP_EM = 3.5
TOP, BOTTOM, FOOTNOTE_ZONE = 0.92, 0.08, 0.28
FOOTNOTE_SIZE, HEADING_SIZE, HEADING_WIDTH, HEADING_CHARS = 0.86, 1.18, 0.75, 90
CROSSING_MOST, BALANCE_LEAST, COLUMN_LINES = 0.15, 0.2, 6
INDENT, RAGGED, GAP = (0.03, 0.25), 0.12, 1.5
PAGE_NUMBER = r"(?i)^(page\s+)?[ivxlcdm\d]{1,6}$"
HEADING_WORDS = "(?i)^(chapter|part|section|appendix|prologue|epilogue)(?![A-Za-z0-9_])"
LINE_END = "[.!?][\"')\\]]?$"
HYPHEN = "[‐-—-]"
# White space, and that around a text as T.squash has it: Java's end of a text may stand before a last U+0085.
SPACES, SPACE_BEGINS, SPACE_ENDS = re.compile(f"{T.SPACE}+", re.ASCII), re.compile(f"^{T.SPACE}", re.ASCII), re.compile(f"{T.SPACE}\\Z", re.ASCII)
SPACE_AROUND = re.compile("^ | (?=\u0085?\\Z)")
SPACE_BYTES = np.array([SPACE_BEGINS.match(chr(b)) is not None for b in range(128)] + [False] * 128)
#: Where white space other than single spaces between words may stand.
ODD_SPACE = "  |^ | $| \u0085|[\t-\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def gutter_fractions() -> list[float]:
    """Candidate gutters from .35 to .65 of the width, by repeated addition of .01."""
    out, x = [], 0.35
    while x <= 0.65:
        out.append(x)
        x += 0.01
    return out


def group_lines(runs: DataFrame) -> DataFrame:
    """Glyph runs (doc_id, page, seq, text, x0, x1, y, font_size), one row each, to the lines of page_lines."""
    return page_lines(packed_runs(runs))


def packed_runs(runs: DataFrame) -> DataFrame:
    """doc_id, page, runs: the runs of each page in one row. It sorts a row for each run; a source that has its runs
    page by page needs none of it."""
    run = F.struct("seq", "text", "x0", "x1", "y", "font_size")
    return runs.where(F.length("text") > 0).groupBy("doc_id", "page").agg(F.collect_list(run).alias("runs"))


def page_lines(pages: DataFrame, runs: Callable[[pa.RecordBatch], dict] | None = None) -> DataFrame:
    """pages (doc_id, page, runs), runs being an array of (seq, text, x0, x1, y, font_size), to lines (doc_id, page,
    line_no, text, x0, x1, y, font_size), without a shuffle."""
    cut = paged_lines(pages, runs).select("doc_id", "page", F.posexplode("lines").alias("line_no", "l"))
    return cut.select("doc_id", "page", "line_no", "l.*")


def paged_lines(pages: DataFrame, runs: Callable[[pa.RecordBatch], dict] | None = None) -> DataFrame:
    """The same lines as an array for each page: doc_id, page, lines.

    Runs follow one another down the page and from left to right. One goes on with the line if it stands on the baseline
    of the line's first run and no column gap right of the run before it. A source that has its runs inside the task
    gives a function from a batch of its pages, whose texts lie in lists named lines, to columns of runs, with page, the
    batch's row; then no run passes between the JVM and Python.
    """
    kinds = pages.schema
    schema = f"doc_id {kinds['doc_id'].dataType.simpleString()}, page {kinds['page'].dataType.simpleString()}, lines array<struct<text:string,x0:double,x1:double,y:double,font_size:double>>"
    held, read = ("runs", _held_runs) if runs is None else ("lines", runs)

    def lines(batches):
        for batch in batches:
            for part in W.parts(batch, held):
                keys = [part.column(c) for c in ("doc_id", "page")]
                yield pa.record_batch([*keys, _lines_of_runs(part.num_rows, **read(part))], ["doc_id", "page", "lines"])

    return pages.select("doc_id", "page", held).mapInArrow(lines, schema)


def _held_runs(batch: pa.RecordBatch) -> dict:
    lists = batch.column("runs")
    runs = lists.flatten()
    return {"page": pc.list_parent_indices(lists).to_numpy(), **{c: runs.field(c) for c in ("seq", "text", "x0", "x1", "y", "font_size")}}


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a < b as Spark has it, NaN being the greatest number."""
    return (a < b) | (np.isnan(b) & ~np.isnan(a))


def _down_the_page(page: np.ndarray, runs: dict) -> np.ndarray:
    """The places of the runs by page, from the top, from the left and by seq, nulls first; then by what else they hold,
    so that the order never depends on that of the input."""
    keys = []
    for c in ("font_size", "y", "x1", "text", "seq", "x0", "y"):
        column = runs[c]
        if c == "text":
            column = pc.rank(column, tiebreaker="dense")
        values = column.cast(pa.float64() if c != "seq" else pa.int64())
        numbers = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
        keys.append(-numbers if c == "y" else numbers)
        if values.null_count:
            keys.append(~values.is_null().to_numpy(zero_copy_only=False))
    return np.lexsort([*keys, page])


def _lines_of_runs(pages: int, page, **runs) -> pa.Array:
    """The lines of so many pages, a list for each."""
    offsets, _ = W.pieces(runs["text"])
    kept = np.flatnonzero(np.diff(offsets) > 0)
    if len(kept) < len(page):
        page, runs = page[kept], {c: v.take(pa.array(kept)) for c, v in runs.items()}
    if not _in_order(page, runs):
        order = _down_the_page(page, runs)
        page, runs = page[order], {c: v.take(pa.array(order)) for c, v in runs.items()}
    x0, x1, y, size = (W.numbers(runs[c].cast(pa.float64())) for c in ("x0", "x1", "y", "font_size"))
    there = {c: ~runs[c].is_null().to_numpy(zero_copy_only=False) if runs[c].null_count else np.ones(len(page), bool) for c in ("x0", "x1", "y", "font_size")}
    gap = np.full(len(page), np.nan)
    gap[1:] = x0[1:] - x1[:-1]
    measured = there["x0"] & there["font_size"]
    measured[1:] &= there["x1"][:-1]
    parted = ~(measured & _less(gap, size * COLUMN_GAP_EM))
    parted[1:] |= np.diff(page) > 0
    parted[:1] = True
    begins = _new_baselines(parted, y, there["y"], size)
    first = np.flatnonzero(begins)
    space = ~begins & _less(size * 0.2, gap)
    offsets, data = W.pieces(runs["text"])
    if space.any():
        ends, starts = _spaced(runs["text"], offsets, data)
        space &= ~starts
        space[1:] &= ~ends[:-1]
    # a line's text: the bytes of its runs, moved on by the spaces before them
    moved = np.cumsum(space)
    out = np.full(len(data) + (moved[-1] if len(moved) else 0), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(moved, np.diff(offsets))] = data
    text = _squashed(W.strings(np.append(offsets[first] + moved[first], len(out)), out))
    wide = _greatest(x1, there["x1"], first)
    tall = _greatest(size, there["font_size"], first)
    left, base = (pa.array(c[first], mask=~there[n][first]) for c, n in ((x0, "x0"), (y, "y")))
    shown = pc.not_equal(text, "")
    columns = [c.filter(shown) for c in (text, left, wide, base, tall)]
    counts = np.bincount(page[first][shown.to_numpy(zero_copy_only=False)], minlength=pages)
    return pa.ListArray.from_arrays(pa.array(W.summed(counts), pa.int32()), pa.StructArray.from_arrays(columns, ["text", "x0", "x1", "y", "font_size"]))


def _in_order(page: np.ndarray, runs: dict) -> bool:
    """Whether the runs stand strictly in order already, as an extractor mostly gives them."""
    if any(runs[c].null_count for c in ("seq", "x0", "y")):
        return False
    x0, y, seq = W.numbers(runs["x0"]), W.numbers(runs["y"]), runs["seq"].to_numpy(zero_copy_only=False)
    right = (x0[1:] > x0[:-1]) | ((x0[1:] == x0[:-1]) & (seq[1:] > seq[:-1]))
    return bool(np.all((page[1:] > page[:-1]) | ((page[1:] == page[:-1]) & ((y[1:] < y[:-1]) | ((y[1:] == y[:-1]) & right)))))


def _new_baselines(parted: np.ndarray, y: np.ndarray, there: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which runs begin a line; no line goes over a parted run.

    A run as high and as tall as the one before it stands on the same line. Of the others each needs the line's first
    run: all parts advance together, one such run a round.
    """
    begins = parted.copy()
    alike = np.zeros(len(y), bool)
    alike[1:] = (y[1:] == y[:-1]) & (size[1:] == size[:-1]) & np.isfinite(y[1:]) & ~parted[1:]
    at = np.flatnonzero(~alike)
    starts = np.flatnonzero(parted[at])
    lengths = np.diff(np.append(starts, len(at)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    base = at[starts]
    for k in range(1, lengths[0] if len(lengths) else 0):
        n = np.searchsorted(-lengths, -k, "left")  # the parts that have more than k such runs
        i, b = at[starts[:n] + k], base[:n]
        near = np.where(np.isnan(size[i]), np.nan, np.maximum(1.5, size[i] * 0.4))
        fresh = ~(there[i] & there[b] & ~_less(near, np.abs(y[b] - y[i])))
        begins[i] = fresh
        base[:n] = np.where(fresh, i, b)
    return begins


def _spaced(text: pa.Array, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts end, and which begin, with white space; none is empty."""
    ends, starts = SPACE_BYTES[data[offsets[1:] - 1]], SPACE_BYTES[data[offsets[:-1]]]
    odd = np.flatnonzero((data[offsets[1:] - 1] > 127) | (data[offsets[:-1]] > 127))
    words = text.take(pa.array(odd)).dictionary_encode()
    known, of = words.dictionary.to_pylist(), words.indices.to_numpy()
    for found, rule in ((ends, SPACE_ENDS), (starts, SPACE_BEGINS)):
        found[odd] = np.array([rule.search(w) is not None for w in known], bool)[of]
    return ends, starts


def _squashed(text: pa.Array) -> pa.Array:
    """White space runs become one space; none stays at the ends."""
    odd = np.flatnonzero(pc.match_substring_regex(text, ODD_SPACE).to_numpy(zero_copy_only=False))
    if not len(odd):
        return text
    mended = [SPACE_AROUND.sub("", SPACES.sub(" ", t)) for t in text.take(pa.array(odd)).to_pylist()]
    mask = np.zeros(len(text), bool)
    mask[odd] = True
    return pc.replace_with_mask(text, pa.array(mask), pa.array(mended, pa.string()))


def _greatest(values: np.ndarray, there: np.ndarray, first: np.ndarray) -> pa.Array:
    """The greatest value of each line, nulls left out, NaN being the greatest number."""
    if not len(first):
        return pa.array([], pa.float64())
    none = ~np.logical_or.reduceat(there, first)
    return pa.array(np.maximum.reduceat(np.where(there, values, -np.inf), first), mask=none)


def _weight() -> Column:
    return F.greatest(F.lit(1), F.floor(F.length("text") / 10 + 0.5))


def _median_size(sizes: DataFrame) -> DataFrame:
    """sizes (doc_id, font_size, w, of a size one row or several) with c, the weight up to a row's size, and all."""
    along = Window.partitionBy("doc_id").orderBy("font_size")
    return sizes.withColumn("c", F.sum("w").over(along)).withColumn("all", F.sum("w").over(Window.partitionBy("doc_id")))


def body_size(lines: DataFrame) -> DataFrame:
    """doc_id, body: the upper median font size, each line weighted by its length."""
    run = _median_size(lines.groupBy("doc_id", "font_size").agg(F.sum(_weight()).alias("w")))
    return run.where(F.col("c") > F.floor(F.col("all") / 2)).groupBy("doc_id").agg(F.min("font_size").alias("body"))


def margin_key(text: Column) -> Column:
    return T.squash(F.regexp_replace(F.lower(text), r"\d+", "#"))


def in_margin() -> Column:
    return (F.col("y") > F.col("height") * TOP) | (F.col("y") < F.col("height") * BOTTOM)


def _least_pages(n: Column) -> Column:
    """On how many of n pages a margin text must stand to count as repeated."""
    return F.when(n <= 4, 2).otherwise(F.greatest(F.lit(3), F.ceil(n * 0.25)))


def repeated_margins(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, key: margin texts, digits masked, on enough of a document's pages."""
    key = margin_key(F.col("text"))
    keys = lines.join(pages.select("doc_id", "page", "height").hint("shuffle_hash"), ["doc_id", "page"]).where(in_margin()).select("doc_id", "page", key.alias("key")).where("key <> ''").distinct()
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    return keys.groupBy("doc_id", "key").count().join(n, "doc_id").where(F.col("count") >= _least_pages(F.col("n"))).select("doc_id", "key")


def _judgement(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, body and keys, the repeated margins of a document, from one reading of its lines.

    Lines shrink first to a row for each page, size and margin text, and only those rows are sorted.
    """
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n")).hint("shuffle_hash")
    key = F.nullif(F.when(in_margin(), margin_key(F.col("text"))), F.lit(""))
    met = lines.join(pages.hint("shuffle_hash"), ["doc_id", "page"], "left").select("doc_id", "page", "font_size", key.alias("key"), _weight().alias("w"))
    few = met.groupBy("doc_id", "page", "font_size", "key").agg(F.sum("w").alias("w")).join(n, "doc_id", "left")
    first = F.row_number().over(Window.partitionBy("doc_id", "key", "page").orderBy("font_size")) == 1
    seen = few.withColumn("first", first.cast("int")).withColumn("on", F.sum("first").over(Window.partitionBy("doc_id", "key")))
    body = F.min(F.when(F.col("c") > F.floor(F.col("all") / 2), F.col("font_size")))
    return _median_size(seen).groupBy("doc_id").agg(body.alias("body"), F.collect_set(F.when(F.col("on") >= _least_pages(F.col("n")), F.col("key"))).alias("keys"))


def classify(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines with width, height, body and drop: margin, footnote or null; margins are judged first."""
    # pages get what is known of their document first, so that lines move once
    about = pages.join(_judgement(lines, pages).hint("shuffle_hash"), "doc_id", "left")
    met = lines.join(about.hint("shuffle_hash"), ["doc_id", "page"])
    noise = in_margin() & (F.col("text").rlike(PAGE_NUMBER) | F.array_contains("keys", margin_key(F.col("text"))))
    small = (F.col("font_size") <= F.col("body") * FOOTNOTE_SIZE) & (F.col("y") < F.col("height") * FOOTNOTE_ZONE)
    return met.withColumn("drop", F.when(noise, "margin").when(small, "footnote")).drop("keys")


def gutters(lines: DataFrame) -> DataFrame:
    """doc_id, page, gutter: the candidate with fewest crossings, then most balance, then first; only near-empty ones
    on pages of enough lines count. lines carry the page width.

    A line crosses the candidates from the first one right of its start up to the first one at or right of its end, and
    lies left of those after. Pages collect these two ends of each line, and two running sums over the candidates, up
    at the ends of the one kind and down at the other, count all lines at once.
    """
    candidates = gutter_fractions()
    places = [F.col("width") * f for f in candidates]
    at_most = lambda edge, strict: sum((((x < edge) if strict else (x <= edge)).cast("int") for x in places[1:]), ((places[0] < edge) if strict else (places[0] <= edge)).cast("int"))
    ends = lines.select("doc_id", "page", "width", at_most(F.col("x0"), False).alias("low"), at_most(F.col("x1"), True).alias("high"))
    ends = ends.withColumn("low", F.least("low", "high")).groupBy("doc_id", "page", "low", "high").agg(F.count("*").alias("n"), F.max("width").alias("width"))
    pages = ends.groupBy("doc_id", "page").agg(F.collect_list(F.struct("low", "high", "n")).alias("e"), F.sum("n").alias("n"), F.max("width").alias("width"))

    def moved(at: Column, end: str) -> Column:
        return F.aggregate(F.filter("e", lambda x: x[end] == at), F.lit(0).cast("long"), lambda s, x: s + x["n"])

    table = F.array(*[F.lit(f) for f in candidates])
    zero = F.lit(0).cast("long")
    kind = "struct<crossings:bigint,b:double,i:int,x:double>"
    start = F.struct(zero.alias("crossings"), zero.alias("left"), F.lit(None).cast(kind).alias("best"))

    def step(s: Column, i: Column) -> Column:
        ended = moved(i, "high")
        crossings, left = s["crossings"] + moved(i, "low") - ended, s["left"] + ended
        balance = F.least(left, F.col("n") - crossings - left) / F.col("n")
        now = F.struct(crossings.alias("crossings"), (-balance).alias("b"), i.alias("i"), (F.col("width") * F.get(table, i)).alias("x"))
        return F.struct(crossings.alias("crossings"), left.alias("left"), F.least(s["best"], now).alias("best"))

    best = pages.select("doc_id", "page", "n", F.aggregate(F.sequence(F.lit(0), F.lit(len(candidates) - 1)), start, step, lambda s: s["best"]).alias("m"))
    ok = (F.col("n") >= COLUMN_LINES) & (F.col("m.crossings") / F.col("n") <= CROSSING_MOST) & (-F.col("m.b") >= BALANCE_LEAST)
    return best.where(ok).select("doc_id", "page", F.col("m.x").alias("gutter"))


def reading_order(lines: DataFrame) -> DataFrame:
    """lines (with width) plus band, col, spanning and pos, the place on the page in reading order.

    Bands are runs of lines that span the gutter or do not; in a band of columns the left one comes first.
    """
    met = lines.join(gutters(lines).hint("shuffle_hash"), ["doc_id", "page"], "left")
    span = F.coalesce((F.col("x0") < F.col("gutter")) & (F.col("x1") > F.col("gutter")), F.lit(False))
    down = Window.partitionBy("doc_id", "page").orderBy(F.desc("y"), "x0", "line_no")
    rows = met.withColumn("spanning", span).withColumn("turn", F.coalesce((F.col("spanning") != F.lag("spanning").over(down)).cast("int"), F.lit(0)))
    col = F.when(F.col("gutter").isNull() | F.col("spanning") | (F.col("x1") <= F.col("gutter")), 0).otherwise(1)
    rows = rows.withColumn("band", F.sum("turn").over(down)).withColumn("col", col)
    order = Window.partitionBy("doc_id", "page").orderBy("band", "col", F.desc("y"), "x0", "line_no")
    return rows.withColumn("pos", F.row_number().over(order) - 1).drop("turn")


def block_gaps(ordered: DataFrame) -> DataFrame:
    """doc_id, page, band, col, gap: the upper median of positive line distances in each block, zero without any."""
    block = Window.partitionBy("doc_id", "page", "band", "col").orderBy("pos")
    steps = ordered.select("doc_id", "page", "band", "col", (F.lag("y").over(block) - F.col("y")).alias("d"))
    lists = steps.groupBy("doc_id", "page", "band", "col").agg(F.array_sort(F.collect_list(F.when(F.col("d") > 0, F.col("d")))).alias("g"))
    return lists.select("doc_id", "page", "band", "col", _block_gap(F.col("g")).alias("gap"))


def _block_gap(distances: Column) -> Column:
    """The upper median of a block's sorted positive line distances, zero without any."""
    return F.coalesce(F.get(distances, F.floor(F.size(distances) / 2).cast("int")), F.lit(0.0))


def arranged(judged: DataFrame) -> DataFrame:
    """The kept ones of classified lines in reading order, with page_width, the width of the page's text."""
    page = Window.partitionBy("doc_id", "page")
    return reading_order(judged.where("drop is null").withColumn("page_width", F.max("x1").over(page) - F.min("x0").over(page)))


def paragraphs(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, para, text, page, heading: noise removed, columns in order, lines joined over columns and pages."""
    return assembled(arranged(classify(lines, pages)))


def assembled(ordered: DataFrame) -> DataFrame:
    """The paragraphs of arranged lines, dealt by document once: blocks and pages lie inside these parts."""
    block = Window.partitionBy("doc_id", "page", "band", "col")
    down = F.lag("y").over(block.orderBy("pos")) - F.col("y")
    rows = ordered.repartition("doc_id").withColumn("d", down).withColumn("g", F.collect_list(F.when(F.col("d") > 0, F.col("d"))).over(block))
    rows = rows.withColumn("gap", _block_gap(F.array_sort("g"))).drop("d", "g").withColumn("left", F.min("x0").over(block)).withColumn("right", F.max("x1").over(block))
    rows = rows.withColumn("w", F.greatest(F.col("right") - F.col("left"), F.lit(1.0))).withColumn("i", F.row_number().over(block.orderBy("pos")) - 1)
    big = (F.col("font_size") >= F.col("body") * HEADING_SIZE) & (F.col("x1") - F.col("x0") < F.col("page_width") * HEADING_WIDTH) & ~F.col("text").rlike(LINE_END)
    rows = rows.withColumn("heading", (F.length("text") <= HEADING_CHARS) & (F.col("text").rlike(HEADING_WORDS) | big))
    flow = Window.partitionBy("doc_id").orderBy("page", "pos")
    before = {c: F.lag(c).over(flow) for c in ("heading", "spanning", "x1", "right", "w", "y", "text")}
    step = F.col("x0") - F.col("left")
    indented = (step > F.col("w") * INDENT[0]) & (step < F.col("w") * INDENT[1])
    inside = ((F.col("gap") > 0) & (before["y"] - F.col("y") > F.col("gap") * GAP)) | indented | (before["text"].rlike(LINE_END) & (before["x1"] < F.col("right") - F.col("w") * RAGGED))
    across = indented | (before["x1"] < before["right"] - before["w"] * RAGGED)
    begins = before["heading"].isNull() | F.col("heading") | before["heading"] | ((F.col("i") == 0) & (F.col("spanning") | before["spanning"])) | F.when(F.col("i") > 0, inside).otherwise(across)
    numbered = rows.withColumn("begins", begins.cast("int")).withColumn("p", F.sum("begins").over(flow))
    lists = numbered.groupBy("doc_id", "p").agg(F.array_sort(F.collect_list(F.struct("page", "pos", "text"))).alias("l"), F.min("page").alias("page"), F.bool_or("heading").alias("heading"))
    text = join_lines(F.col("l.text"))
    out = lists.select("doc_id", "p", text.alias("text"), "page", "heading").where("text <> ''")
    return out.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("p")) - 1).alias("para"), "text", "page", "heading")


def join_lines(lines: Column) -> Column:
    """Lines joined by spaces; a hyphen before a lower-case letter at a line's start goes with the break."""
    return T.squash(F.regexp_replace(F.array_join(F.filter(F.transform(lines, T.trimmed), lambda x: x != ""), "\n"), f"{HYPHEN}\n(?=[a-z])", ""))


def clean_stats(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, body, margin_lines, footnote_lines, column_pages."""
    judged = classify(lines, pages)
    return stats_of(judged, arranged(judged))


def stats_of(judged: DataFrame, ordered: DataFrame) -> DataFrame:
    """The same from classified lines and the arranged ones among them."""
    pages = ordered.groupBy("doc_id", "page").agg((F.countDistinct("band", "col") > 1).alias("several"), (F.max("col") > 0).alias("right"))
    columns = pages.groupBy("doc_id").agg(F.count_if(F.col("several") | F.col("right")).alias("column_pages"))
    dropped = judged.groupBy("doc_id").agg(F.first("body").alias("body"), F.count_if(F.col("drop") == "margin").alias("margin_lines"), F.count_if(F.col("drop") == "footnote").alias("footnote_lines"))
    return dropped.join(columns, "doc_id", "left").na.fill({"column_pages": 0})
