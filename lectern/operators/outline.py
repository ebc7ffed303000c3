"""Outlines: nested entries walked into reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import storage as S
from lectern.functions import text as T


def walk_outline(nodes: DataFrame) -> DataFrame:
    """doc_id, seq, title, page, level of nested entries (doc_id, node, parent, place, title, page) in pre-order.

    parent is null at the top, place orders the entries of one parent, and level is the depth. Titles are squashed;
    entries with a blank title are left out but what stands under them stays, as deep as it was. Entries that hang
    under no top entry, in a cycle or below one that is not there, are left out. Each entry points at an ancestor and
    knows the path from there; a round doubles how far it points, so an outline d deep takes log2(d) rounds, each
    written to the shared folder.
    """
    kept = S.stored(nodes.select("doc_id", "node", "parent", "place", T.squash(F.col("title")).alias("title"), "page"))
    step = F.array(F.struct("place", "node"))
    pending = kept.where("parent is not null").select("doc_id", "node", F.col("parent").alias("up"), step.alias("path"))
    rooted = kept.where("parent is null").select("doc_id", "node", step.alias("path"))
    most = kept.groupBy("doc_id").count().agg(F.max("count")).first()[0] or 0
    rounds = 0
    while 2**rounds <= most and not pending.isEmpty():
        top = rooted.select("doc_id", F.col("node").alias("up"), F.col("path").alias("before"), F.lit(None).cast(kept.schema["node"].dataType).alias("next"))
        further = pending.select("doc_id", F.col("node").alias("up"), F.col("path").alias("before"), F.col("up").alias("next"))
        met = S.stored(pending.join(top.unionByName(further), ["doc_id", "up"]).select("doc_id", "node", F.col("next").alias("up"), F.concat("before", "path").alias("path")))
        rooted = rooted.unionByName(met.where("up is null").drop("up"))
        pending, rounds = met.where("up is not null"), rounds + 1
    order = Window.partitionBy("doc_id").orderBy("path")
    named = rooted.join(kept.select("doc_id", "node", "title", "page"), ["doc_id", "node"]).where("title <> ''")
    return named.select("doc_id", (F.row_number().over(order) - 1).alias("seq"), "title", "page", (F.size("path") - 1).alias("level"))
