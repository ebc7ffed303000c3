"""Speech synthesis behind a cache: each text is synthesized once for each voice, and one that fails stops no other."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from py4j.protocol import Py4JError

from lectern.functions import storage as S
from lectern.operators.library import audio_key

CACHE, ATTEMPTS = "key string, blob binary", "key string, blob binary, error string"
log = logging.getLogger(__name__)


def keyed(utterances: DataFrame) -> DataFrame:
    """key, speech, voice_id of utterances (cache_key, speech, voice_id), each key once, with the smallest speech."""
    keys = utterances.select(audio_key(F.col("cache_key"), F.col("voice_id")).alias("key"), "speech", "voice_id")
    return keys.groupBy("key").agg(F.min("speech").alias("speech"), F.first("voice_id").alias("voice_id"))


def missing_audio(utterances: DataFrame, cache: DataFrame) -> DataFrame:
    """Those of the keyed utterances whose audio is not in the cache."""
    return keyed(utterances).join(cache.select("key"), "key", "left_anti")


def attempts(missing: DataFrame, client: Callable[[str, str | None], bytes]) -> DataFrame:
    """key with blob, or with error where the client raised one. client: (text, voice) -> bytes."""

    def ask(text, voice):
        try:
            return client(text, voice), None
        except Exception as error:  # whatever the engine says stays with its row
            return None, f"{type(error).__name__}: {error}"

    def run(batches):
        for batch in batches:
            found = [ask(text, voice) for text, voice in zip(batch["speech"], batch["voice_id"])]
            yield pd.DataFrame({"key": batch["key"], "blob": [b for b, _ in found], "error": [e for _, e in found]})

    return missing.mapInPandas(run, ATTEMPTS)


def synthesize(utterances: DataFrame, cache: DataFrame, client: Callable[[str, str | None], bytes]) -> DataFrame:
    """The cache (key, blob) and what was asked for in addition: key, blob, error."""
    return cache.select("key", "blob", F.lit(None).cast("string").alias("error")).unionByName(attempts(missing_audio(utterances, cache), client))


def cached(utterances: DataFrame, path: str) -> DataFrame:
    """key, blob of the cache table at path; no rows where there is none yet or it cannot be read."""
    spark = utterances.sparkSession
    try:
        return S.stored(spark.read.schema(CACHE).parquet(path).join(keyed(utterances).select("key"), "key", "left_semi"))
    except (AnalysisException, PySparkException, Py4JError) as error:
        if not (isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND"):
            log.warning("the audio cache cannot be read and is asked past: %s", error)
        return spark.createDataFrame([], CACHE)


def get_or_synthesize(utterances: DataFrame, path: str, client: Callable[[str, str | None], bytes]) -> DataFrame:
    """key, blob, error, status (cached, made, failed) of each key once; what was made is added to the cache at path.

    Attempts are written before they are read, so the client is asked once for each key unless a task is run again.
    Failed keys are not in the cache and are asked again by the next call. A cache that cannot be read counts as empty,
    and one that cannot be written costs only the next call's time. Null speech fails like any text the client refuses.
    """
    there = cached(utterances, path)
    tried = S.stored(attempts(missing_audio(utterances, there), client))
    try:
        tried.where("error is null").select("key", "blob").write.mode("append").parquet(path)
    except (AnalysisException, PySparkException, Py4JError) as error:
        log.warning("the audio cache cannot be written: %s", error)
    made = tried.withColumn("status", F.when(F.col("error").isNull(), "made").otherwise("failed"))
    return there.select("key", "blob", F.lit(None).cast("string").alias("error"), F.lit("cached").alias("status")).unionByName(made)
