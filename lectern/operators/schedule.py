"""Narration: speech units, pauses, utterances, timelines and seeks, as windows over a document's chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

# Milliseconds of silence, the slower rate of headings, utterances queued ahead.
SENTENCE, PARAGRAPH, BEFORE_HEADING, AFTER_HEADING = 220, 460, 900, 650
HEADING_RATE = 0.94
LOOKAHEAD = 3
UNIT_END = "[.!?][\"')\\]”’]?$"


@dataclass(frozen=True)
class Provider:
    """What a speech engine can do: report word boundaries, play requests without a seam, and render silence itself."""

    id: str = "web"
    supports_boundaries: bool = True
    supports_queueing: bool = True
    honours_delays: bool = False


def units(chunked: DataFrame, *carried: str) -> DataFrame:
    """doc_id, chunk_idx, unit, text, token_start, token_count, ends_sentence: the sentences of each chunk, with the
    chunk's columns named in carried."""
    found = F.transform(T.sentences(T.squash(F.col("text"))), lambda t, i: F.struct(i.alias("unit"), t.alias("text"), T.count_words(t).alias("token_count")))
    start = F.struct(F.array().cast("array<struct<unit:int,text:string,token_start:int,token_count:int>>").alias("out"), F.lit(0).alias("words"))

    def add(s: Column, x: Column) -> Column:
        row = F.struct(x["unit"].alias("unit"), x["text"].alias("text"), s["words"].alias("token_start"), x["token_count"].alias("token_count"))
        return F.struct(F.concat(s["out"], F.array(row)).alias("out"), (s["words"] + x["token_count"]).alias("words"))

    placed = F.aggregate(F.filter(found, lambda x: x["token_count"] > 0), start, add, lambda s: s["out"])
    cut = chunked.select("doc_id", F.col("idx").alias("chunk_idx"), *carried, F.explode(placed).alias("u"))
    return cut.select("doc_id", "chunk_idx", "u.unit", "u.text", "u.token_start", "u.token_count", F.col("u.text").rlike(UNIT_END).alias("ends_sentence"), *carried)


def structural_pauses(chunked: DataFrame) -> DataFrame:
    """The chunks with pause_ms, the silence that headings and paragraphs ask for before each."""
    along = Window.partitionBy("doc_id").orderBy("idx")
    before = F.lag("heading").over(along)
    pause = F.when(before.isNull(), 0).when(F.col("heading"), BEFORE_HEADING).when(before, AFTER_HEADING).when(F.col("starts_para"), PARAGRAPH).otherwise(0)
    return chunked.withColumn("pause_ms", pause)


def unit_pauses(chunked: DataFrame) -> DataFrame:
    """The units with heading, pause_ms before each, and the next unit's position.

    A new chunk's structural silence comes first; else a beat after a unit that ended a sentence; a sentence that is
    split over chunks is never broken.
    """
    along = Window.partitionBy("doc_id").orderBy("chunk_idx", "unit")
    all_units = units(structural_pauses(chunked).withColumnRenamed("pause_ms", "structural"), "heading", "structural")
    last = F.lag("chunk_idx").over(along)
    pause = (
        F.when(last.isNull(), 0)
        .when((F.col("chunk_idx") != last) & (F.col("structural") > 0), F.col("structural"))
        .when(F.lag("ends_sentence").over(along), SENTENCE)
        .otherwise(0)
    )
    following = F.lead(F.struct("chunk_idx", "unit")).over(along)
    return all_units.select("*", pause.alias("pause_ms"), following["chunk_idx"].alias("next_chunk"), following["unit"].alias("next_unit")).drop("structural")


def utterances(chunked: DataFrame, rate: float = 1.0, voice_id: str | None = None, provider: Provider = Provider()) -> DataFrame:
    """One row for each unit that has something to say, with speech text, rate, pause and breath group.

    A silent unit is skipped and leaves the pause owed before it to the next spoken one. A unit is queued behind the one
    before if the engine queues and either no pause is owed or the engine renders it, as pre_delay_ms; else a timer
    waits timer_ms. A breath group runs as long as units are queued; up to LOOKAHEAD of it may be queued ahead.
    highlight is word where the engine reports boundaries, else unit.
    """
    return planned(spoken_units(chunked), rate, voice_id, provider)


def spoken_units(chunked: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, unit, token_start, heading, speech, and owed, the pause before each unit that has something to
    say: what is alike for every rate, voice and engine."""
    units = unit_pauses(chunked).withColumn("speech", T.to_speech(F.col("text"))["text"])
    along = Window.partitionBy("doc_id").orderBy("chunk_idx", "unit")
    spoken = F.col("speech") != ""
    grouped = units.withColumn("grp", F.coalesce(F.sum(spoken.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = Window.partitionBy("doc_id", "grp").orderBy("chunk_idx", "unit")
    owed = grouped.withColumn("owed", F.when(F.col("grp") == 0, 0).otherwise(F.first("pause_ms").over(within))).where(spoken)
    return owed.select("doc_id", "chunk_idx", "unit", "token_start", "heading", "speech", "owed")


def planned(told: DataFrame, rate: float = 1.0, voice_id: str | None = None, provider: Provider = Provider()) -> DataFrame:
    """The utterances of spoken units for one engine."""
    along = Window.partitionBy("doc_id").orderBy("chunk_idx", "unit")
    follows = F.lag("unit").over(along).isNotNull()
    queued = follows & F.lit(provider.supports_queueing) & ((F.col("owed") == 0) | F.lit(provider.honours_delays))
    out = told.withColumn("queued", queued).withColumn("breath_group", F.sum((~F.col("queued")).cast("int")).over(along) - 1)
    place = F.row_number().over(Window.partitionBy("doc_id", "breath_group").orderBy("chunk_idx", "unit")) - 1
    return out.select(
        "doc_id",
        "chunk_idx",
        "unit",
        "speech",
        unit_rate(F.col("heading"), F.lit(rate)).alias("rate"),
        F.lit(voice_id).cast("string").alias("voice_id"),
        F.col("owed").alias("pause_ms"),
        F.concat_ws(":", "doc_id", "chunk_idx", "token_start").alias("cache_key"),
        "breath_group",
        F.least(place, F.lit(LOOKAHEAD)).alias("queued_behind"),
        F.when(F.col("queued"), F.col("owed")).otherwise(0).alias("pre_delay_ms"),
        F.when(F.col("queued"), 0).otherwise(F.col("owed")).alias("timer_ms"),
        F.lit("word" if provider.supports_boundaries else "unit").alias("highlight"),
    )


def unit_rate(heading: Column, rate: Column) -> Column:
    return F.when(heading, rate * HEADING_RATE).otherwise(rate)


def begin_at(unit_rows: DataFrame, requests: DataFrame) -> DataFrame:
    """For each request (doc_id, chunk_idx, token): the unit to start with and the words of it to drop.

    A token beyond the chunk's last word starts its last unit at the beginning.
    """
    met = requests.join(unit_rows.select("doc_id", "chunk_idx", "unit", "token_start", "token_count", "text"), ["doc_id", "chunk_idx"])
    row = F.struct("unit", "token_start", "text")
    holds = F.when(F.col("token") < F.col("token_start") + F.col("token_count"), row)
    found = met.groupBy("doc_id", "chunk_idx", "token").agg(F.min(holds).alias("hit"), F.max(row).alias("last"))
    drop = F.when(F.col("hit").isNotNull(), F.greatest(F.col("token") - F.col("hit.token_start"), F.lit(0))).otherwise(0)
    chosen = F.coalesce("hit", "last")
    rest = F.array_join(F.slice(T.tokens(chosen["text"]), drop + 1, F.greatest(F.size(T.tokens(chosen["text"])), F.lit(1))), " ")
    return found.select("doc_id", "chunk_idx", "token", chosen["unit"].alias("unit"), drop.alias("dropped"), rest.alias("rest"))


def timeline(chunked: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, words, words_before: spoken lengths as integers; seconds come last."""
    counted = chunked.select("doc_id", F.col("idx").alias("chunk_idx"), T.count_words(F.col("text")).cast("long").alias("words"))
    before = Window.partitionBy("doc_id").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("words_before", F.coalesce(F.sum("words").over(before), F.lit(0)))


def timed(times: DataFrame, rate: float = 1.0) -> DataFrame:
    """start_s and duration_s of each chunk at a rate."""
    return times.select("doc_id", "chunk_idx", "words", F.round(T.estimate_seconds(F.col("words_before"), rate), 6).alias("start_s"), F.round(T.estimate_seconds(F.col("words"), rate), 6).alias("duration_s"))


def chunk_at(times: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (doc_id, seconds): the last chunk that starts at or before it; negative seconds count as zero."""
    starts = times.select("doc_id", T.estimate_seconds(F.col("words_before")).alias("at"), "chunk_idx", F.lit(None).cast("double").alias("seconds"))
    asked = probes.select("doc_id", F.greatest(F.col("seconds"), F.lit(0.0)).alias("at"), F.lit(None).cast("int").alias("chunk_idx"), F.col("seconds").cast("double").alias("seconds")).distinct()
    so_far = Window.partitionBy("doc_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = starts.unionByName(asked).withColumn("chunk_idx", F.max("chunk_idx").over(so_far))
    return found.where("seconds is not null and chunk_idx is not null").select("doc_id", "seconds", "chunk_idx")


def elapsed(times: DataFrame, positions: DataFrame, rate: float = 1.0) -> DataFrame:
    """For each position (doc_id, chunk_idx, token): seconds into the document at a rate, and its whole length."""
    whole = times.groupBy("doc_id").agg(F.sum("words").alias("all_words"))
    met = positions.join(times, ["doc_id", "chunk_idx"]).join(whole, "doc_id")
    part = F.when(F.col("words") > 0, F.least(F.col("token"), F.col("words")) / F.col("words")).otherwise(0.0)
    at = T.estimate_seconds(F.col("words_before"), rate) + part * T.estimate_seconds(F.col("words"), rate)
    return met.select("doc_id", "chunk_idx", "token", F.round(at, 6).alias("elapsed_s"), F.round(T.estimate_seconds(F.col("all_words"), rate), 6).alias("duration_s"))


def clamp_seek(target: Column, last: Column) -> Column:
    return F.least(F.greatest(target, F.lit(0)), last)


def clamp_rate(rate: Column, least: float = 0.5, most: float = 3.0) -> Column:
    return F.least(F.greatest(rate, F.lit(least)), F.lit(most))


def web_rate(rate: Column) -> Column:
    """A narrator speed as the web engine takes it."""
    return clamp_rate(rate, 0.5, 4.0)


def system_rate(rate: Column, normal: float = 0.5) -> Column:
    """A narrator speed of 0.5 to 3 on the system engine's scale of 0 to 1, where normal is the voice's own pace."""
    speed = clamp_rate(rate)
    return F.when(speed <= 1, speed * normal).otherwise(normal + (speed - 1) * ((1 - normal) / 2))


def player_status(engaged: Column, paused: Column, finished: Column) -> Column:
    return F.when(~engaged & finished, "ended").when(~engaged, "idle").when(paused, "paused").otherwise("playing")
