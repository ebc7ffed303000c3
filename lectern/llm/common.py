"""Settings and small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one group of documents may hold when work is dealt by group.
GROUP_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; a private one only where the session names none and runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
        return context.getCheckpointDir()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like cut, but as Parquet, for rows of which later steps read some columns only."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups_for(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> int:
    """How many groups of about group_bytes the texts make: it grows with the input, so a group does not."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // group_bytes))


def document_group(groups: int):
    """A document's group, from its id and text so that neither nulls nor repeated ids meet in one group."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(groups)).cast("int")


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns; columns that a table lacks are null, extra ones are left out."""
    kinds = {"doc_id": "bigint", "text": "string"}
    there = set(docs.columns)
    return docs.select(*[F.col(n) if n in there else F.lit(None).cast(kinds.get(n, "string")).alias(n) for n in names])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
