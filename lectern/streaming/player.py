"""Reader events as streams: last-write-wins progress, the player's state per book, and the silences between units."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: How event types drive the player.
ACTIONS = {"view": "play", "click": "seek", "purchase": "pause", "error": "stop", "signup": "resume"}
#: How long after a later event an event may still come, and the span whose events of one book are put in order at once.
LATE, SPAN_MS = "1 minute", 86_400_000
#: Rows of one key that wait in one list.
FEW = 2000
PLAYER = "event_id long, book_id long, status string, chunk_idx int"
BEATS = "doc_id long, chunk_idx int, unit int, pause_ms int, starts_ms long"
#: Later than any event.
END = "2200-01-01 00:00:00"


def with_action(events: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return events.withColumn("action", F.try_element_at(table, F.col("event_type")))


def progress(writes: DataFrame) -> DataFrame:
    """book_id, chunk_idx, updated_at: the newest write of each book; the same for a stream and a table."""
    return writes.groupBy("book_id").agg(F.max_by("chunk_idx", F.struct("ts", "event_id")).alias("chunk_idx"), F.max("ts").alias("updated_at"))


def player_states(events: DataFrame) -> DataFrame:
    """event_id, book_id, status, chunk_idx after each event of a table.

    play starts, stop goes idle, pause and resume work only on what plays or is paused, seek moves; order: ts, event_id.
    """
    along = Window.partitionBy("book_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    acts = with_action(events)
    turn = F.last(F.when(F.col("action").isin("play", "stop"), F.col("action")), ignorenulls=True).over(along)
    toggle = F.last(F.when(F.col("action").isin("play", "pause", "resume"), F.col("action")), ignorenulls=True).over(along)
    status = F.when(F.coalesce(turn, F.lit("stop")) == "stop", "idle").when(toggle == "pause", "paused").otherwise("playing")
    at = F.coalesce(F.last(F.when(F.col("action").isin("play", "seek"), F.col("chunk_idx")), ignorenulls=True).over(along), F.lit(0))
    return acts.select("event_id", "book_id", status.alias("status"), at.alias("chunk_idx"))


class Waiting(StatefulProcessor):
    """Rows of one key that wait in the state until their time has come, and are then taken in order.

    Up to few rows of a key wait in one list with one timer at the earliest time, so that a key with some rows costs a
    few calls a batch however many spans they fall into. What is beyond waits by span: waiting maps a time to its rows
    and a timer stands at each such time; then one span of one key is held at a time, however many rows a key has.
    Timers fire in the order of time once the watermark has passed them. Rows are tuples that begin with what orders
    them inside their span.
    """

    ROW = ""

    def __init__(self, few: int = FEW) -> None:
        self.most = few

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.few = handle.getListState("few", self.ROW)
        self.count = handle.getValueState("count", "rows int, next long")
        self.waiting = handle.getMapState("waiting", "due long", f"rows array<struct<{self.ROW}>>")

    def time(self, row: tuple) -> int | None:
        """When the row came about, in milliseconds; what the watermark has passed by then is dropped."""
        raise NotImplementedError

    def due(self, row: tuple) -> int | None:
        raise NotImplementedError

    def release(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = [c.split(" ")[0] for c in self.ROW.split(", ")]
        passed = timerValues.getCurrentWatermarkInMs()
        dated = ((self.due(row), row) for row in (tuple(r[n] for n in names) for r in rows) if self.time(row) is not None and self.time(row) >= passed)
        came = (x for x in dated if x[0] is not None)
        held, earliest = self.count.get() if self.count.exists() else (0, None)
        new = list(itertools.islice(came, self.most - held))
        more = list(itertools.islice(came, self.most))
        if new:
            first = min(due for due, _ in new)
            self.few.appendList([row for _, row in new])
            if earliest is None or first < earliest:
                self.handle.registerTimer(first)
                earliest = first
            self.count.update((held + len(new), earliest))
        if more or self.waiting.exists():  # beside spans, every time in the list has a timer of its own
            for due in {self.due(tuple(r)) for r in self.few.get()}:
                self.handle.registerTimer(due)
        while more:
            for due, part in itertools.groupby(sorted(more, key=lambda x: x[0]), lambda x: x[0]):
                old = [tuple(r) for r in self.waiting.getValue((due,))[0]] if self.waiting.containsKey((due,)) else []
                self.waiting.updateValue((due,), (old + [row for _, row in part],))
                self.handle.registerTimer(due)
            more = list(itertools.islice(came, self.most))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The rows up to this time; where none waits by span, all that the watermark has passed."""
        due = expiredTimerInfo.getExpiryTimeInMs()
        spans = self.waiting.exists()
        past = due if spans else max(due, timerValues.getCurrentWatermarkInMs())
        ready = []
        if self.count.exists() and self.count.get()[1] <= past:
            held = [tuple(r) for r in self.few.get()]
            ready, left = [r for r in held if self.due(r) <= past], [r for r in held if self.due(r) > past]
            if left:
                following = min(map(self.due, left))
                self.few.put(left)
                self.count.update((len(left), following))
                self.handle.registerTimer(following)
            else:
                self.few.clear()
                self.count.clear()
        if spans and self.waiting.containsKey((due,)):
            ready += [tuple(r) for r in self.waiting.getValue((due,))[0]]
            self.waiting.removeKey((due,))
        return self.release(key, sorted(ready, key=lambda r: (self.due(r), *r[:2]))) if ready else iter([])

    def close(self) -> None:
        pass


class Player(Waiting):
    """The player of one book: status and chunk after each of its events in the order of ts, event_id."""

    ROW, OUT = "at long, event_id long, action string, chunk_idx int", PLAYER

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.now = handle.getValueState("now", "status string, chunk_idx int")

    def time(self, row: tuple) -> int | None:
        return None if row[0] is None else row[0] // 1000

    def due(self, row: tuple) -> int:
        return (row[0] // 1000 // SPAN_MS + 1) * SPAN_MS

    def release(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        status, at = self.now.get() if self.now.exists() else ("idle", 0)
        out = []
        for _, event, action, chunk in rows:
            if action == "play":
                status = "playing"
            elif action == "stop":
                status = "idle"
            elif action == "pause" and status == "playing":
                status = "paused"
            elif action == "resume" and status == "paused":
                status = "playing"
            if action in ("play", "seek"):
                at = chunk
            out.append(Row(event_id=event, book_id=key[0], status=status, chunk_idx=at))
        self.now.update((status, at))
        return iter(out)


class Beats(Waiting):
    """The beat of one document: a unit starts when the silence owed before it is over."""

    ROW, OUT = "chunk_idx int, unit int, pause_ms int, asked_ms long", BEATS

    def time(self, row: tuple) -> int | None:
        return row[3]

    def due(self, row: tuple) -> int | None:
        return None if row[2] is None else row[3] + row[2]

    def release(self, key: tuple, rows: list[tuple]) -> Iterator[Row]:
        for chunk, unit, pause, asked in rows:
            yield Row(doc_id=key[0], chunk_idx=chunk, unit=unit, pause_ms=pause, starts_ms=asked + pause)


def _with_timers(rows: DataFrame, key: str, processor: Waiting) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy(key).transformWithState(processor, processor.OUT, "append", "EventTime").where(F.col(key).isNotNull())


def player_stream(events: DataFrame, late: str = LATE, few: int = FEW) -> DataFrame:
    """player_states for a stream: an event is answered once no earlier one can come, those later than late are dropped.

    The last events of a stream that ends wait for a later one; in_time_order closes a table's with one. A null book_id
    has no player.
    """
    keyed = with_action(events).select("book_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "action", "chunk_idx").withWatermark("ts", late)
    return _with_timers(keyed.withColumn("at", F.unix_micros("ts")), "book_id", Player(few))


def beats_stream(units: DataFrame, late: str = LATE, few: int = FEW) -> DataFrame:
    """units (doc_id, chunk_idx, unit, pause_ms, ts), each asked for at ts, as they start: a timer counts each one's silence."""
    asked = units.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    started = _with_timers(asked.withColumn("asked_ms", F.unix_millis("ts")), "doc_id", Beats(few))
    return started.select("doc_id", "chunk_idx", "unit", "pause_ms", F.timestamp_millis("starts_ms").alias("starts_at"))


def in_time_order(rows: DataFrame, folder: str, files: int = 3) -> DataFrame:
    """A table as a stream of files in the order of its ts, one a batch, and a last row of nulls at END that lets all before it go."""
    spark = rows.sparkSession
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    edges = timed.select(F.percentile_approx(F.unix_micros("ts"), [k / files for k in range(1, files)], 10_000)).first()[0] or []
    part = sum(((F.unix_micros("ts") > edge).cast("int") for edge in edges), F.lit(0))
    for k in range(files):
        timed.where(part == k).repartition(1).write.mode("append").parquet(folder)
    end = [F.lit(END).cast("timestamp").alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in timed.schema]
    spark.range(1).select(*end).repartition(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drop_stale(callbacks: DataFrame) -> DataFrame:
    """callbacks (book_id, seq, session, …) of the session that is newest when they arrive."""
    along = Window.partitionBy("book_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return callbacks.withColumn("newest", F.max("session").over(along)).where("session = newest").drop("newest")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drain(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """All that the stream gives for the input there is now, written as Parquet to the folder and read as a table.

    A batch that runs again replaces its own files; in complete mode the last batch holds the whole result.
    """
    name = f"drained_{uuid.uuid4().hex}"
    written: dict[int, str] = {}

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{name}/rows/{number}")
        written[number] = f"{folder}/{name}/rows/{number}"

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/{name}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    if not written:
        return stream.sparkSession.createDataFrame([], stream.schema)
    paths = [written[max(written)]] if mode == "complete" else list(written.values())
    return stream.sparkSession.read.schema(stream.schema).parquet(*paths)
