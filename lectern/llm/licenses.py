"""License scans by diagonal voting, in DataFrame operations only.

All rolling k-gram hashes of a document's words meet the template positions with the same hash. A meeting votes for
the diagonal (document position less template position); neighbouring diagonals are merged, so a few inserted or
dropped words do no harm, and a merged span counts if its votes cover enough of the template.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only
from .decontam import lower_ascii, words_of

K = 3
#: Share of a template's k-grams that a span must hold, and how far diagonals of one span may lie apart.
COVERAGE = 0.8
NEAR = 3
#: Templates of up to so many words must be covered whole. Of notices that begin at one word the best covered counts.
SHORT = 12

# Base phrases and their labels.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

# Notices of public licenses, as words.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """hash, template, label, base, size (words) and at (word position) of every k-gram of every template."""
    rows = [F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(n < len(phrases)).alias("base"), F.lit(words).alias("words")) for n, (label, words) in enumerate([*phrases, *notices])]
    every = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*").withColumn("w", F.split("words", " "))
    return every.select("template", "label", "base", "words", F.size("w").alias("size"), F.posexplode(rolling("w")).alias("at", "hash"))


def rolling(words: str):
    """The hash of each K consecutive words; fewer words have none."""
    starts = F.when(F.size(words) >= K, F.sequence(F.lit(0), F.size(words) - K)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(K)]))


def scan(docs: DataFrame, known: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """For each document row: doc_id, n_words, places (starts of base phrases), base_labels, labels, score, spans.

    spans: the verified (label, first, stop) stretches of words, base phrases included; score is the largest share of a
    template covered, 1 for a base phrase. Words are compared after lower-casing A-Z. Null and empty texts have no words; a
    null doc_id is kept; repeated rows are scanned each on its own; an empty table gives no rows; other columns are
    ignored. known has a bounded number of rows (the templates) and is sent to all tasks.
    """
    words = F.transform(F.array_remove(words_of(F.col("text")), ""), lower_ascii)
    split = only(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", words.alias("w"))
    hashed = split.select("row", "doc_id", "w", F.size("w").alias("n_words"), rolling("w").alias("h"))
    dealt = hashed.select("row", "doc_id", "w", "n_words", F.posexplode(F.concat("h", F.array(F.lit(None).cast("long")))).alias("pos", "hash"))
    met = dealt.join(F.broadcast(known), "hash", "left").where(F.col("template").isNotNull() | F.col("hash").isNull())
    votes = met.select("row", "doc_id", "n_words", "template", "label", "base", "size", "pos", "at", (F.col("pos") - F.col("at")).alias("diagonal"), F.when(F.col("base"), same_words()).alias("exact"))

    one = votes.groupBy("row", "template", "diagonal").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.first("label").alias("label"),
        F.first("base").alias("base"),
        F.first("size").alias("size"),
        F.collect_set("at").alias("ats"),
        F.min("pos").alias("first"),
        (F.max("pos") + K).alias("stop"),
        F.bool_and("exact").alias("exact"),
    )
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) > NEAR) | (F.col("first") > F.lag("stop").over(along) + NEAR)
    islands = one.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("island", F.sum("apart").over(along))
    spans = islands.groupBy("row", "template", "island").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "n_words", "label", "base", "size", "exact")],
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("covered"),
        F.min("first").alias("first"),
        F.max("stop").alias("stop"),
    )
    share = F.col("covered") / (F.col("size") - K + 1)
    needed = F.when(F.col("size") <= SHORT, 1.0).otherwise(coverage)
    best = F.max("share").over(Window.partitionBy("row", "base", "first"))
    fits = F.when(F.col("base"), F.col("exact") & (F.col("share") == 1.0)).otherwise((F.col("share") >= needed) & (F.col("share") == best) & (F.col("stop") - F.col("first") <= F.col("size") * 1.5))
    judged = spans.withColumn("share", share.cast("double")).withColumn("fits", F.coalesce(fits, F.lit(False)))
    base = F.col("fits") & F.col("base")
    return judged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").cast("long").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("fits"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(F.col("fits"), F.struct("first", "stop", "label")))).alias("spans"),
    )


def same_words():
    """Whether the words along the diagonal are the template's."""
    start = F.col("pos") - F.col("at")
    return F.when((start >= 0) & (start + F.col("size") <= F.col("n_words")), F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("size")), " ") == F.col("words")).otherwise(False)
