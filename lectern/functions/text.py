"""Text expressions: white space, words, sentence boundaries, speech rewriting, titles, clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space beyond ASCII counts as white space.
SPACE = r"[\s   -     　﻿]"

# Words before a full stop that do not end a sentence.
SENTENCE_ABBREVIATIONS = "mr mrs ms dr prof st sr jr vs etc al fig figs eq no vol pp ed eds cf e.g i.e approx inc ltd co".split()
CLOSERS = "[\"')\\]”’]"
OPENS_SENTENCE = "[\"'(“‘—]?[A-Z0-9]"

# Abbreviations that are read out as words.
SPOKEN_ABBREVIATIONS = {
    "e.g.": "for example", "i.e.": "that is", "etc.": "et cetera", "et": "et", "al.": "others", "vs.": "versus", "vs": "versus", "cf.": "compare",
    "fig.": "figure", "figs.": "figures", "eq.": "equation", "eqs.": "equations", "ref.": "reference", "refs.": "references", "sec.": "section",
    "ch.": "chapter", "pp.": "pages", "p.": "page", "no.": "number", "approx.": "approximately", "ca.": "circa", "est.": "estimated", "incl.": "including",
}
# Symbols that are read out as words.
SYMBOLS = {
    "=": "equals", "+": "plus", "±": "plus or minus", "×": "times", "÷": "divided by", "<": "less than", ">": "greater than", "≤": "less than or equal to",
    "≥": "greater than or equal to", "≈": "approximately", "≠": "not equal to", "→": "to", "∞": "infinity", "∑": "the sum of", "√": "the square root of",
    "∂": "partial", "%": "percent", "°": "degrees", "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "θ": "theta", "λ": "lambda",
    "μ": "mu", "π": "pi", "σ": "sigma", "φ": "phi", "ω": "omega", "Δ": "delta", "Σ": "sigma", "Ω": "omega", "&": "and", "@": "at", "§": "section", "©": "copyright",
}
BULLETS = "^[•·▪◦‣*■●–—|]+$"
PUNCTUATION = r"[.,;:!?)\]]+"

WORDS_PER_MINUTE = 165


def squash(text: Column) -> Column:
    """White space runs become one space; none stays at the ends."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


#: Where white space other than single spaces may stand: strings, and the bytes that such characters begin with.
ODD_SPACE, ODD_BYTES = ("  ", "\t", "\n", "\x0b", "\f", "\r"), ("C285", "C2A0", "E19A80", "E280", "E2819F", "E38080", "EFBBBF")


def squash_bound(text: Column) -> Column:
    """The same for a bound value, which is named often here: plain searches spare most texts the pattern."""
    odd = text.startswith(" ") | text.endswith(" ")
    for s in ODD_SPACE:
        odd = odd | text.contains(s)
    for b in ODD_BYTES:
        odd = odd | F.contains(text.cast("binary"), F.expr(f"X'{b}'"))
    return F.when(odd, squash(text)).otherwise(text)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def tokens(text: Column) -> Column:
    """The words between white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.size(tokens(text))


def _ends_sentence(word: Column, following: Column) -> Column:
    """Whether a sentence ends at a word that the end of the text or an opening word follows."""

    def spared(stem: Column) -> Column:
        return (
            F.regexp_replace(stem, "[^a-z.]", "").isin(SENTENCE_ABBREVIATIONS)
            | stem.rlike("^[a-z]$")
            | (stem.rlike("[0-9]$") & F.coalesce(following.rlike("^[0-9]"), F.lit(False)))
        )

    stem = F.lower(F.regexp_extract(word, f"([^(]*)[.!?]{CLOSERS}*$", 1))
    dotted = word.rlike(rf"\.{CLOSERS}*$")
    return word.rlike(f"[.!?]{CLOSERS}*$") & ~(dotted & F.exists(F.array(stem), spared))


def sentences(text: Column) -> Column:
    """The sentences of a squashed text.

    It is cut behind every word that ends in a mark or a closer where the next one may open a sentence; of such a part
    the last word and the next part's first one decide whether a sentence ends there. The parts are bound to a name, so that the text is cut once and not again
    for each word; so are the two words and the stem.
    """
    last, first = (lambda s: F.substring_index(s, " ", -1)), (lambda s: F.substring_index(s, " ", 1))

    def marked(parts: Column) -> Column:
        ends = lambda s, i: F.exists(F.array(F.struct(last(s).alias("word"), first(F.get(parts, i + 1)).alias("next"))), lambda at: _ends_sentence(at["word"], at["next"]))
        return F.array_join(F.transform(parts, lambda s, i: F.when(ends(s, i), F.concat(s, F.lit("\u0001"))).otherwise(s)), " ")

    # the space stands first in the pattern, since few places hold one
    bound = F.transform(F.array(F.split(text, f" (?<=(?:[.!?]|{CLOSERS}) )(?={OPENS_SENTENCE})")), marked)
    return F.filter(F.split(bound[0], "\u0001 ?"), lambda s: s != "")


def packed(pieces: Column, limit: int) -> Column:
    """Consecutive pieces joined by a space as long as they stay within limit; a longer piece stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))

    def add(state: Column, piece: Column) -> Column:
        full = (state["now"] != "") & (F.length(state["now"]) + F.length(piece) + 1 > limit)
        return F.struct(
            F.when(full, F.concat(state["out"], F.array(state["now"]))).otherwise(state["out"]).alias("out"),
            F.when(full | (state["now"] == ""), piece).otherwise(F.concat(state["now"], F.lit(" "), piece)).alias("now"),
        )

    return F.filter(F.aggregate(pieces, start, add, lambda s: F.concat(s["out"], F.array(s["now"]))), lambda x: x != "")


def speak_token(token: Column) -> Column:
    """The spoken words of one display token, possibly none."""
    word = trimmed(F.regexp_replace(F.regexp_replace(token, r"\[\s*\d+(\s*[–—,-]\s*\d+)*\s*\]", ""), "[¹²³⁰⁴-⁹]", ""))
    dashed = F.regexp_replace(word, rf"{SPACE}*[—–]{SPACE}*", ", ")
    lower = F.regexp_replace(F.lower(dashed), "^[(\"'“‘]+", "")
    table = F.create_map(*[F.lit(x) for pair in SPOKEN_ABBREVIATIONS.items() for x in pair])
    long = F.coalesce(F.try_element_at(table, lower), F.try_element_at(table, F.regexp_replace(lower, "[,;:)]+$", "")))
    named = dashed
    for symbol, name in SYMBOLS.items():
        named = F.replace(named, F.lit(symbol), F.lit(f" {name} "))
    named = F.when(dashed.rlike("[" + "".join(SYMBOLS) + "]"), named).otherwise(dashed)
    kept = F.array_join(F.filter(tokens(named), lambda p: ~p.rlike(BULLETS)), " ")
    glued = F.regexp_replace(kept, f" +(?={PUNCTUATION}( |$))", "")
    none = F.array().cast("array<string>")
    # most tokens are letters and end punctuation, and are spoken as they are
    plain = token.rlike(r"^[A-Za-z\u00c0-\u024f']+[.,;:!?]*$") & ~F.regexp_replace(F.lower(token), "^'+|[,;:]+$", "").isin(list(SPOKEN_ABBREVIATIONS))
    return (
        F.when(plain, F.array(token))
        .when((word == "") | word.rlike(BULLETS), none)
        .when(word.rlike(r"(?i)^(https?://|www\.)\S+$"), F.array(F.lit("a link")))
        .when(word.rlike(r"(?i)^[^\s@]+@[^\s@]+\.[a-z]{2,}$"), F.array(F.lit("an email address")))
        .when(long.isNotNull(), F.split(long, " "))
        .otherwise(F.filter(F.split(glued, " "), lambda p: p != ""))
    )


def to_speech(display: Column) -> Column:
    """text, and words: the offset in it of each spoken word with the number of its display token."""
    spoken = F.flatten(F.transform(tokens(display), lambda t, i: F.transform(speak_token(t), lambda w: F.struct(w.alias("w"), i.alias("token")))))
    start = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<offset:int,token:int>>").alias("words"))

    def add(state: Column, x: Column) -> Column:
        glue = (state["text"] != "") & x["w"].rlike(f"^{PUNCTUATION}$")
        gap = F.when(glue | (state["text"] == ""), "").otherwise(" ")
        entry = F.struct((F.length(state["text"]) + F.length(gap)).alias("offset"), x["token"].alias("token"))
        return F.struct(F.concat(state["text"], gap, x["w"]).alias("text"), F.when(glue, state["words"]).otherwise(F.concat(state["words"], F.array(entry))).alias("words"))

    return F.aggregate(spoken, start, add)


def entries_up_to(entries: Column, value: Column, key: str) -> Column:
    """How many of the entries, sorted by their field key, have it at or below value: the range is halved until it is empty."""
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(F.size(entries) + 1.0)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(entries).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.coalesce(F.get(entries, middle)[key] <= value, F.lit(False))
        there = s["low"] < s["high"]
        return F.struct(F.when(there & below, middle + 1).otherwise(s["low"]).alias("low"), F.when(there & ~below, middle).otherwise(s["high"]).alias("high"))

    return F.aggregate(halvings, start, halve, lambda s: s["low"])


def token_at_offset(words: Column, offset: Column) -> Column:
    """The display token of the last spoken word that begins at or before offset, else -1."""
    return F.coalesce(F.get(words, entries_up_to(words, offset, "offset") - 1)["token"], F.lit(-1))


def token_index_at(text: Column, offset: Column) -> Column:
    """The number of the word that holds the character at offset; a space belongs to the word before it."""
    return F.when(offset <= 0, 0).otherwise(F.greatest(F.lit(0), F.size(tokens(F.substring(text, F.lit(1), offset + 1))) - 1))


def estimate_seconds(words: Column, rate: Column | float = 1.0) -> Column:
    return words / (F.lit(WORDS_PER_MINUTE) * rate) * 60


def usable_title(title: Column) -> Column:
    """The trimmed title, or null for placeholders, file names and anything shorter than two characters."""
    t = trimmed(title)
    junk = t.rlike(r"(?i)^(untitled|unknown|document\d*|microsoft word|pdf document)$") | t.rlike(r"(?i)^microsoft word\s*-") | t.rlike(r"(?i)\.(docx?|pdf|epub|indd|tex|pages|odt)$")
    return F.when((F.length(t) < 2) | junk, None).otherwise(t)


def usable_author(author: Column) -> Column:
    a = trimmed(author)
    return F.when((a == "") | a.rlike("(?i)^(anonymous|unknown|user|administrator|owner)$"), None).otherwise(a)


def match_title(text: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and spaces as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", " "), " +", " "))


def _many(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def time_left(seconds: Column) -> Column:
    minutes = F.greatest(F.lit(1), F.floor(seconds / 60 + 0.5)).cast("long")
    hours, rest = F.floor(minutes / 60).cast("long"), minutes % 60
    return F.concat(F.when(hours == 0, _many(rest, "min")).when(rest == 0, _many(hours, "hr")).otherwise(F.concat(_many(hours, "hr"), F.lit(" "), _many(rest, "min"))), F.lit(" left"))


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour; negative and missing numbers show as zero."""
    number = seconds.cast("double")
    s = F.when(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")) | (number < 0), 0).otherwise(F.floor(number + 0.5)).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def rate_label(rate: Column) -> Column:
    """Two decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.2f", rate.cast("double")), r"\.?0+$", "")


def resolve_path(base: Column, href: Column) -> Column:
    """href against the folder of base: no fragment, `.` and `..` folded; a leading slash starts at the root."""
    path = F.split(href, "#")[0]
    folder = F.regexp_replace(base, "[^/]*$", "")
    parts = F.filter(F.split(F.concat(folder, path), "/"), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    folded = F.aggregate(parts, none, lambda out, p: F.when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))))
    return F.when(path == "", base).when(path.startswith("/"), F.substr(path, F.lit(2))).otherwise(F.array_join(folded, "/"))


# The preview's bounds, and the sentence that stands in for a short one.
PREVIEW_LEAST, PREVIEW_MOST = 40, 220
PREVIEW_STOCK = "It was a bright cold day in April, and the clocks were striking thirteen."


def bookmark_excerpt(text: Column, token: Column) -> Column:
    """Nine tokens from the current one, else the first 60 characters."""
    words = tokens(text)
    part = F.array_join(F.slice(words, F.greatest(token, F.lit(0)) + 1, F.lit(9)), " ")
    return F.when(part != "", part).otherwise(F.substring(text, 1, 60))


def preview_sample(text: Column, stock: str = PREVIEW_STOCK) -> Column:
    t = trimmed(text)
    cut = F.concat(F.regexp_replace(F.substring(t, 1, PREVIEW_MOST), rf"{SPACE}\S*\z", ""), F.lit("…"))
    return F.when(t.isNull() | (F.length(t) < PREVIEW_LEAST), stock).when(F.length(t) > PREVIEW_MOST, cut).otherwise(t)
