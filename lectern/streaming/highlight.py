"""Highlighted words: the boundary events of an engine, a stream, against the spoken words of its utterances, a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T


def spoken_words(texts: DataFrame) -> DataFrame:
    """texts (doc_id, text, token_start) to doc_id, token_start and words, the offset of each spoken word with its display token."""
    return texts.select("doc_id", "token_start", T.to_speech(F.col("text"))["words"].alias("words"))


def highlights(boundaries: DataFrame, spoken: DataFrame) -> DataFrame:
    """boundaries (doc_id, at, …), a stream or a table, with token: the display word to highlight.

    It is the last spoken word that begins at or before the offset, found by halving the sorted words; an offset
    before the first word, and a null one, highlight the utterance's first. Boundaries of an unknown utterance stay, with null.
    spoken holds one row for each utterance; if it does not fit in memory the join deals both sides by doc_id.
    """
    known = spoken.select(F.col("doc_id").alias("said"), "token_start", "words")
    met = boundaries.join(known, F.col("doc_id") == F.col("said"), "left")
    found = T.token_at_offset(F.col("words"), F.col("at"))
    return met.select(*boundaries.columns, F.when(F.col("said").isNotNull(), F.col("token_start") + F.greatest(found, F.lit(0))).alias("token"))
