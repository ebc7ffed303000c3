"""Markup: tokens, entities, content paragraphs, packages and tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

# Named entities, and the elements that are skipped, end a paragraph, or are headings.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“",
    "rdquo": "”", "laquo": "«", "raquo": "»", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß",
    "copy": "©", "reg": "®", "trade": "™", "deg": "°", "shy": "",
}
SKIPPED = ["script", "style", "head", "title", "nav", "svg", "figure", "table"]
BLOCKS = "p div li blockquote section article header footer h1 h2 h3 h4 h5 h6 pre figcaption dd dt tr hr".split()
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]

#: Comments, CDATA, declarations, tags (quotes protect `>`), text, and an unterminated tag as text.
TOKEN = r"""(?s)(<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?](?:[^>]*>|.*)|<(?:[^'">]++|"[^"]*+"|'[^']*+')*+>|[^<]+|<.*)"""
ATTRIBUTE = r"""([^\s=/>"']+)\s*=\s*("[^"]*"|'[^']*')"""


def decode_entities(text: Column) -> Column:
    """Decimal, hexadecimal and named entities; unknown ones stay as they are. Nothing is decoded twice."""
    parts = F.split(text, r"(?=&(?:#x?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)")
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def one(part: Column) -> Column:
        body = F.regexp_extract(part, r"^&(#[xX]?[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);", 1)
        rest = F.substr(part, F.length(body) + 3)
        digits = F.when(body.rlike("^#[xX]"), F.conv(F.substr(body, F.lit(3)), 16, 10)).when(body.rlike("^#[0-9]+$"), F.substr(body, F.lit(2)))
        code = digits.try_cast("bigint")
        letter = F.when((code >= 0) & (code <= 0x10FFFF), _character(code))
        return F.when(body == "", part).otherwise(F.coalesce(F.concat(F.coalesce(letter, F.try_element_at(names, F.lower(body))), rest), part))

    return F.when(text.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def _character(code: Column) -> Column:
    """The character of a code point, by its four UTF-32 bytes."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def tokens(documents: DataFrame, markup: str = "markup") -> DataFrame:
    """The columns of documents but the markup, and pos, kind (open, close, text), name, attrs, self_closing, text."""
    raw = F.regexp_extract_all(F.col(markup), F.lit(TOKEN), F.lit(1))
    kept = [c for c in documents.columns if c != markup]
    cut = documents.select(*kept, F.posexplode(raw).alias("pos", "raw"))
    r = F.col("raw")
    cdata, tag = r.startswith("<![CDATA["), r.startswith("<") & r.endswith(">") & ~r.rlike("^<[!?]")
    close = tag & r.startswith("</")
    kind = F.when(r.startswith("<!--") | (r.rlike("^<[!?]") & ~cdata), None).when(cdata, "text").when(close, "close").when(tag, "open").otherwise("text")
    inner = F.regexp_replace(r, r"^</?\s*|/?>$", "")
    name = F.lower(F.regexp_replace(F.regexp_extract(inner, r"^[^\s/>]+", 0), r"^.*:", ""))
    pairs = F.regexp_extract_all(inner, F.lit(f"({ATTRIBUTE})"), F.lit(1))
    entry = F.transform(
        pairs,
        lambda p: F.struct(
            F.lower(F.regexp_replace(F.regexp_extract(p, r"^[^\s=]+", 0), r"^.*:", "")).alias("key"),
            decode_entities(F.regexp_replace(F.regexp_replace(p, r"^[^=]*=\s*", ""), r"^[\"']|[\"']$", "")).alias("value"),
        ),
    )
    last = F.filter(entry, lambda x, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda y: y["key"] == x["key"]))
    text = F.when(cdata, F.regexp_replace(r, r"(?s)^<!\[CDATA\[|\]\]>$", "")).when(kind == "text", decode_entities(r))
    return (
        cut.where(kind.isNotNull())
        .select(
            *kept,
            "pos",
            kind.alias("kind"),
            F.when(tag, name).alias("name"),
            F.when(kind == "open", F.map_from_entries(last)).alias("attrs"),
            ((kind == "open") & r.endswith("/>")).alias("self_closing"),
            text.alias("text"),
        )
        .where("kind <> 'text' or text <> ''")
    )


def _column(path: Column | str) -> Column:
    """A path given as text, or as a column among the keys."""
    return F.lit(path) if isinstance(path, str) else path


def clamped(df: DataFrame, delta: Column, name: str, *keys: str) -> DataFrame:
    """The running value of max(0, depth + delta) after each row."""
    along = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("_c", F.sum(delta).over(along))
    return plain.withColumn(name, F.col("_c") - F.least(F.lit(0), F.min("_c").over(along))).drop("_c")


def paragraphs(token_rows: DataFrame, *keys: str) -> DataFrame:
    """keys, para, text, heading: the text between block elements, without skipped elements; headings marked."""
    skip = F.when(F.col("name").isin(SKIPPED), F.when((F.col("kind") == "open") & ~F.col("self_closing"), 1).when(F.col("kind") == "close", -1).otherwise(0)).otherwise(0)
    shown = clamped(token_rows, skip, "skip", *keys).where((F.col("skip") == 0) & ~F.coalesce(F.col("name").isin(SKIPPED), F.lit(False)))
    block = F.coalesce(F.col("name").isin(BLOCKS), F.lit(False))
    deeper = F.when(F.col("name").isin(HEADINGS), F.when(F.col("kind") == "open", 1).otherwise(-1)).otherwise(0)
    along = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = clamped(shown, deeper, "depth", *keys).withColumn("block", F.sum(block.cast("int")).over(along))
    piece = F.when(F.col("kind") == "text", F.col("text")).when((F.col("name") == "br") & (F.col("kind") == "open"), " ")
    pieces = marked.withColumn("piece", piece).where("piece is not null")
    joined = pieces.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"), F.bool_or(F.col("depth") > 0).alias("heading"))
    text = T.squash(F.array_join(F.col("p.piece"), ""))
    kept = joined.select(*keys, "block", text.alias("text"), "heading").where("text <> ''")
    return kept.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("block")) - 1).alias("para"), "text", "heading")


def container_path(token_rows: DataFrame, *keys: str) -> DataFrame:
    """keys, opf_path: the package named by the first rootfile with a path."""
    path = F.col("attrs")["full-path"]
    return token_rows.where((F.col("kind") == "open") & (F.col("name") == "rootfile") & (path != "")).groupBy(*keys).agg(F.min_by(path, "pos").alias("opf_path"))


def manifest(token_rows: DataFrame, *keys: str) -> DataFrame:
    """keys, id, href, properties; the last item of an id counts."""
    a = F.col("attrs")
    items = token_rows.where((F.col("kind") == "open") & (F.col("name") == "item") & (a["id"] != "") & (a["href"] != ""))
    rows = items.select(*keys, "pos", a["id"].alias("id"), a["href"].alias("href"), F.coalesce(a["properties"], F.lit("")).alias("properties"))
    return rows.groupBy(*keys, "id").agg(F.max_by("href", "pos").alias("href"), F.max_by("properties", "pos").alias("properties"), F.min("pos").alias("pos"))


def spine(token_rows: DataFrame, opf_path: Column | str, *keys: str) -> DataFrame:
    """keys, seq, path: manifest files in reading order, without non-linear and unknown ones."""
    a = F.col("attrs")
    refs = token_rows.where((F.col("kind") == "open") & (F.col("name") == "itemref") & (a["idref"] != "") & (F.coalesce(a["linear"], F.lit("")) != "no"))
    met = refs.select(*keys, F.col("pos").alias("at"), a["idref"].alias("id")).join(manifest(token_rows, *keys), [*keys, "id"])
    return met.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1).alias("seq"), T.resolve_path(_column(opf_path), F.col("href")).alias("path"))


def package_info(token_rows: DataFrame, opf_path: Column | str, *keys: str) -> DataFrame:
    """keys, title, author, nav_path, ncx_path of a package document."""
    along = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when((F.col("kind") == "open") & F.col("name").isin("title", "creator"), F.col("name")).when(F.col("kind") == "close", "-")
    reading = token_rows.withColumn("reading", F.last(turn, ignorenulls=True).over(along)).withColumn("plain", T.squash(F.col("text")))
    said = reading.where((F.col("kind") == "text") & (F.col("plain") != ""))
    first = lambda w: F.min_by(F.when(F.col("reading") == w, F.col("plain")), F.when(F.col("reading") == w, F.col("pos")))
    names = said.groupBy(*keys).agg(first("title").alias("title"), first("creator").alias("author"))
    items = manifest(token_rows, *keys)
    nav = items.where(F.array_contains(F.split("properties", r"\s+"), "nav")).groupBy(*keys).agg(F.min_by("href", "pos").alias("nav"))
    toc = token_rows.where((F.col("kind") == "open") & (F.col("name") == "spine")).groupBy(*keys).agg(F.max_by(F.col("attrs")["toc"], "pos").alias("id"))
    ncx = toc.join(items.select(*keys, "id", F.col("href").alias("ncx")), [*keys, "id"]).select(*keys, "ncx")
    path = lambda c: F.when(F.col(c).isNotNull(), T.resolve_path(_column(opf_path), F.col(c)))
    every = token_rows.select(*keys).distinct()
    met = every.join(names, [*keys], "left").join(nav, [*keys], "left").join(ncx, [*keys], "left")
    return met.select(*keys, F.coalesce("title", F.lit("")).alias("title"), "author", path("nav").alias("nav_path"), path("ncx").alias("ncx_path"))


def nav_entries(token_rows: DataFrame, nav_path: Column | str, *keys: str) -> DataFrame:
    """keys, seq, title, href, level: the anchors of a toc nav; level is the list depth where the anchor opens."""
    along = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    toc = F.array_contains(F.split(F.coalesce(F.col("attrs")["type"], F.lit("")), r"\s+"), "toc")
    flag = F.when((F.col("name") == "nav") & (F.col("kind") == "open"), toc).when((F.col("name") == "nav") & (F.col("kind") == "close"), F.lit(False))
    inside = token_rows.withColumn("inside", F.coalesce(F.last(flag, ignorenulls=True).over(along), F.lit(False)))
    step = F.when(F.col("inside") & F.col("name").isin("ol", "ul"), F.when(F.col("kind") == "open", 1).otherwise(-1)).otherwise(0)
    opens = F.col("inside") & (F.col("name") == "a") & (F.col("kind") == "open") & (F.col("attrs")["href"] != "")
    rows = inside.withColumn("depth", F.sum(step).over(along)).withColumn("opens", F.coalesce(opens, F.lit(False)))
    state = F.when(F.col("opens"), F.struct(F.col("pos").alias("at"), F.lit(True).alias("live"))).when((F.col("name") == "a") & (F.col("kind") == "close"), F.struct(F.col("pos").alias("at"), F.lit(False).alias("live")))
    held = rows.withColumn("state", F.last(state, ignorenulls=True).over(along)).where("state.live")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "text")))), lambda x: x["text"]), "")
    href = F.max(F.when(F.col("opens"), F.col("attrs")["href"]))
    level = F.max(F.when(F.col("opens"), F.greatest(F.col("depth") - 1, F.lit(0))))
    entries = held.groupBy(*keys, F.col("state.at").alias("at")).agg(T.squash(said).alias("title"), href.alias("h"), level.cast("int").alias("level")).where("title <> ''")
    return entries.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1).alias("seq"), "title", T.resolve_path(_column(nav_path), F.col("h")).alias("href"), "level")


def ncx_entries(token_rows: DataFrame, ncx_path: Column | str, *keys: str) -> DataFrame:
    """keys, seq, title, href, level: an entry at each content element after a label; level is the navPoint depth."""
    along = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    k, n = F.col("kind"), F.col("name")
    step = F.when(n == "navpoint", F.when(k == "open", 1).otherwise(-1)).otherwise(0)
    label = F.when((n == "navlabel") & (k == "open"), True).when((n == "navlabel") & (k == "close"), False)
    rows = token_rows.withColumn("depth", F.sum(step).over(along) - 1).withColumn("label", F.coalesce(F.last(label, ignorenulls=True).over(along), F.lit(False)))
    reads = F.when((n == "text") & (k == "open") & F.col("label"), True).when((n == "text") & (k == "close"), False)
    rows = rows.withColumn("reads", F.coalesce(F.last(reads, ignorenulls=True).over(along), F.lit(False)))
    starts = ((n == "navlabel") & (k == "open")) | ((n == "content") & (k == "open") & (F.coalesce(F.col("attrs")["src"], F.lit("")) != ""))
    rows = rows.withColumn("part", F.coalesce(F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    said = F.collect_list(F.when((k == "text") & F.col("reads"), F.struct("pos", "text")))
    title = T.squash(F.array_join(F.transform(F.array_sort(said), lambda x: x["text"]), ""))
    end = F.max(F.when((n == "content") & (k == "open"), F.struct("pos", F.col("attrs")["src"].alias("src"), "depth")))
    parts = rows.groupBy(*keys, "part").agg(title.alias("title"), end.alias("end")).where("end.src <> '' and title <> ''")
    return parts.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("part")) - 1).alias("seq"), "title", T.resolve_path(_column(ncx_path), F.col("end.src")).alias("href"), F.greatest(F.col("end.depth"), F.lit(0)).cast("int").alias("level"))


def toc(nav: DataFrame, ncx: DataFrame, *keys: str) -> DataFrame:
    """The nav entries of each book that has any, else its NCX entries."""
    return nav.unionByName(ncx.join(nav.select(*keys).distinct(), list(keys), "left_anti"))


def text_offsets(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, pos and start: where each text token begins in the text of its document, in characters."""
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    texts = rows.where("kind = 'text'")
    return texts.select(*keys, "pos", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("long").alias("start"))
