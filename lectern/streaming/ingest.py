"""Incremental ingest: content documents arrive as a stream and are upserted into a keyed table of chunks.

A table is a folder of batches: documents/batch=N as they came, rows/batch=N what was made of them, and keys/batch=N,
which is written last and makes the batch count. The newest batch of a document holds its rows, so a document that
comes again replaces what it was, one that comes back empty leaves nothing, and a batch that runs again writes its own
folders anew and changes nothing.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from lectern.operators import chunks as C
from lectern.operators import markup as M

#: The share of the bar that reading the documents takes, and where it stands while chapters are found.
READING, CLEANING = 0.9, 0.92
PROGRESS = "step int, stage string, fraction double, page long, page_count long"


class Progress(StreamingQueryListener):
    """Progress rows of one query, from what its batches report; on_progress is called with each (stage, fraction, page, page_count)."""

    def __init__(self, name: str, page_count: int, on_progress: Callable[[tuple], None] | None = None):
        self.name, self.page_count, self.on_progress = name, page_count, on_progress
        self.rows: list[tuple] = []
        self.page, self.ended, self._id = 0, threading.Event(), None

    def report(self, stage: str, fraction: float) -> None:
        row = (stage, fraction, self.page, self.page_count)
        self.rows.append((len(self.rows), *row))
        if self.on_progress:
            self.on_progress(row)

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self._id = event.id
            self.report("reading", 0.0)

    def onQueryProgress(self, event) -> None:
        if event.progress.name == self.name and event.progress.numInputRows:
            self.page = min(self.page_count, self.page + event.progress.numInputRows)
            self.report("extracting", READING * (self.page / self.page_count))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.id == self._id:
            self.ended.set()


def upsert(documents: DataFrame, number: int, table: str) -> None:
    """Batch number of (doc_id, markup): of rows that repeat a doc_id the one with the greatest markup counts; a null doc_id is left out."""
    spark = documents.sparkSession
    one = documents.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("markup").alias("markup"))
    one.write.mode("overwrite").parquet(f"{table}/documents/batch={number}")
    came = spark.read.schema(one.schema).parquet(f"{table}/documents/batch={number}")
    made = C.chunks(M.paragraphs(M.tokens(came.where("markup is not null")), "doc_id").withColumn("page", F.lit(1)))
    made.write.mode("overwrite").parquet(f"{table}/rows/batch={number}")
    came.select("doc_id").write.mode("overwrite").parquet(f"{table}/keys/batch={number}")


def newest(spark: SparkSession, table: str) -> DataFrame:
    """doc_id, batch: the last batch that holds each document."""
    return spark.read.schema("doc_id long, batch long").parquet(f"{table}/keys").groupBy("doc_id").agg(F.max("batch").alias("batch"))


def current(spark: SparkSession, table: str) -> DataFrame:
    """The chunks of all documents as they are now."""
    return spark.read.parquet(f"{table}/rows").join(newest(spark, table), ["doc_id", "batch"]).drop("batch")


def compact(spark: SparkSession, table: str, into: str) -> None:
    """The table as it is now, as one batch of a new table that later batches may follow."""
    last = newest(spark, table).agg(F.max("batch")).first()[0]
    current(spark, table).write.parquet(f"{into}/rows/batch={last}")
    newest(spark, table).select("doc_id").write.parquet(f"{into}/keys/batch={last}")


def ingest_stream(documents: DataFrame, page_count: int, table: str, on_progress: Callable[[tuple], None] | None = None) -> dict[str, DataFrame]:
    """chunks, chapters and progress of a stream of (doc_id, markup) of page_count rows, all that is there now.

    A later call with the same table goes on where the last one ended. Progress runs from 0 to READING with the rows
    read, stands at CLEANING while chapters are found, and ends at 1.
    """
    spark = documents.sparkSession
    listener = Progress(f"ingest_{uuid.uuid4().hex}", page_count, on_progress)
    spark.streams.addListener(listener)
    try:
        run = documents.writeStream.foreachBatch(lambda batch, number: upsert(batch, number, table)).queryName(listener.name)
        run.option("checkpointLocation", f"{table}/log").trigger(availableNow=True).start().awaitTermination()
        listener.ended.wait(30)  # events come on another thread, the last one after the query has ended
    finally:
        spark.streams.removeListener(listener)
    listener.report("cleaning", CLEANING)
    chunked = current(spark, table)
    C.chapters(chunked).write.mode("overwrite").parquet(f"{table}/chapters")
    listener.report("done", 1.0)
    return {"chunks": chunked, "chapters": spark.read.parquet(f"{table}/chapters"), "progress": spark.createDataFrame(listener.rows, PROGRESS)}
