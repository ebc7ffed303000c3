"""The voice catalog: quality tiers, usable and best voices, ordering, favourites, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T

# Novelty voices, the words of good ones, and the list lengths.
NOVELTY = [
    "albert", "bad news", "bahh", "bells", "boing", "bubbles", "cellos", "deranged", "good news", "hysterical", "jester", "junior", "organ", "pipe organ",
    "princess", "ralph", "superstar", "trinoids", "whisper", "wobble", "zarvox",
]
GOOD = r"(?i)(?<![A-Za-z0-9_])(enhanced|premium|natural|neural|online|siri|google|microsoft)(?![A-Za-z0-9_])"
BEST, FAVOURITES = 10, 6


def base_name(name: Column) -> Column:
    return T.squash(F.regexp_replace(name, r"(?i)\s*\((enhanced|premium|compact)\)\s*", " "))


def tier(voices: DataFrame) -> DataFrame:
    """voices with tier and rank; a voice of unknown locality is not taken for a network voice."""
    good = F.col("local_service").eqNullSafe(F.lit(False)) | F.col("name").rlike(GOOD)
    named = F.when(F.lower(base_name(F.col("name"))).isin(NOVELTY), "novelty").when(good, "good").otherwise("legacy")
    return voices.withColumn("tier", named).withColumn("rank", F.when(F.col("tier") == "good", 2).when(F.col("tier") == "legacy", 1).otherwise(0))


def usable(voices: DataFrame) -> DataFrame:
    """No novelty voices, only the best rank of each language, and each name once at its best, the first of equals."""
    serious = tier(voices).where("tier <> 'novelty'")
    language = Window.partitionBy(F.lower(F.substring("lang", 1, 2)))
    kept = serious.withColumn("top", F.max("rank").over(language)).where("rank = top")
    name = Window.partitionBy(F.lower(base_name(F.col("name"))), F.lower("lang")).orderBy(F.desc("rank"), "pos")
    return kept.withColumn("k", F.row_number().over(name)).where("k = 1").drop("k", "top")


def best(voices: DataFrame, language: str, limit: int = BEST) -> DataFrame:
    """The top voices by language match, rank and platform default; ties by name, then by position."""
    lang = F.regexp_replace(F.lower("lang"), "^([^_]*)_", "$1-")
    match = F.when(lang == language.lower(), 3).when(lang.startswith(language[:2].lower()), 2).otherwise(0)
    score = match * 10 + F.col("rank") * 2 + F.coalesce("is_default", F.lit(False)).cast("int")
    return usable(voices).withColumn("score", score).orderBy(F.desc("score"), F.collate("name", "UNICODE"), "pos").limit(limit)


def search(voices: DataFrame, query: str) -> DataFrame:
    needle = query.strip().lower()
    return voices.where(F.lower("name").contains(needle) | F.lower("lang").contains(needle)) if needle else voices


def ordered(voices: DataFrame, favourites: list[str], language: str) -> DataFrame:
    """voices with place: starred ones in starring order, the language's defaults, its others, the rest."""
    starred = F.array_position(F.array(*[F.lit(x) for x in favourites]).cast("array<string>"), F.col("id"))
    local = F.lower("lang").startswith(language[:2].lower())
    rank = F.when(starred > 0, starred - 1).when(local & F.col("is_default"), FAVOURITES + 1).when(local, FAVOURITES + 2).otherwise(FAVOURITES + 3)
    order = Window.orderBy(rank, F.collate("lang", "UNICODE"), F.collate("name", "UNICODE"), "pos")
    return voices.withColumn("place", F.row_number().over(order) - 1)


def shortlist(voices: DataFrame, favourites: list[str]) -> DataFrame:
    """The favourites that exist, in starring order."""
    starred = F.array_position(F.array(*[F.lit(x) for x in favourites]).cast("array<string>"), F.col("id"))
    return voices.withColumn("place", starred - 1).where("place >= 0")


def toggle_favourite(favourites: Column, voice: Column) -> Column:
    """The list without the voice, or with it at the end as long as there is room."""
    return F.when(F.array_contains(favourites, voice), F.array_remove(favourites, voice)).when(F.size(favourites) >= FAVOURITES, favourites).otherwise(F.array_append(favourites, voice))


def preferred(voices: DataFrame, language: str) -> DataFrame:
    """One row: the first default of the language, else its first voice, else the first."""
    return voices.agg(F.min_by("id", _preference(language)).alias("voice_id"))


def resolve(requests: DataFrame, voices: DataFrame, language: str) -> DataFrame:
    """requests (…, book_voice_id, default_voice_id) with voice_id and source.

    A saved voice counts while it exists; an empty catalog means "not known yet" and keeps the saved ids.
    """
    n, auto = voices.agg(F.count("*"), F.min_by("id", _preference(language))).first()
    first = voices.select(F.col("id").alias("book_voice_id"), F.lit(True).alias("book_ok"))
    second = voices.select(F.col("id").alias("default_voice_id"), F.lit(True).alias("default_ok"))
    met = requests.join(first, "book_voice_id", "left").join(second, "default_voice_id", "left")
    if n == 0:
        source = F.when(F.col("book_voice_id") != "", "book").otherwise("default")
        return met.select(*requests.columns, F.coalesce(F.nullif("book_voice_id", F.lit("")), "default_voice_id").alias("voice_id"), source.alias("source"))
    source = F.when(F.col("book_ok"), "book").when(F.col("default_ok"), "default").otherwise("auto")
    chosen = F.when(F.col("book_ok"), F.col("book_voice_id")).when(F.col("default_ok"), F.col("default_voice_id")).otherwise(F.lit(auto))
    return met.select(*requests.columns, chosen.alias("voice_id"), source.alias("source"))


def _preference(language: str) -> Column:
    local = F.lower("lang").startswith(language[:2].lower())
    return F.struct(F.when(local & F.col("is_default"), 0).when(local, 1).otherwise(2), F.col("pos"))


def picker(voices: DataFrame, favourites: list[str], language: str, query: str = "", show_all: bool = False) -> DataFrame:
    """The picker's rows in order: all voices when searching or asked to, else the best ones."""
    pool = voices if query.strip() or show_all else best(voices, language)
    return search(ordered(pool.select(*voices.columns), favourites, language), query)


def parse_voices(setting: Column) -> Column:
    """`id:Label,id:Label` as (id, name, lang); a label may hold colons."""
    parts = F.filter(F.transform(F.split(setting, ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.split(p, ":")[0].alias("id"),
            F.when(p.contains(":"), F.substr(p, F.instr(p, ":") + 1)).otherwise(p).alias("name"),
            F.lit("en-US").alias("lang"),
        ),
    )
