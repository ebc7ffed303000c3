"""Streams keep their rows on disk; the player and the beats answer in the order of time, over several batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lectern.streaming import player as P

EVENT = "book_id long, chunk_idx int, ts timestamp, event_id long, event_type string"
START = dt.datetime(2024, 3, 1)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns or df.columns).collect()), key=str)


def events(n, seed):
    """Random events with ties of ts, most of them of one book."""
    pick = random.Random(seed)
    return [(pick.choice([1, 1, 1, 2, 3]), i % 17, START + dt.timedelta(minutes=pick.randrange(4000)), i, pick.choice([*P.ACTIONS, "other"])) for i in range(n)]


def test_player_over_batches_equals_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "SPAN_MS", 3_600_000)
    table = spark.createDataFrame(events(400, 1), EVENT)
    found = P.drain(P.player_stream(P.in_time_order(table, str(tmp_path / "in"), 3)), str(tmp_path / "out"), "append")
    assert rows(found, "event_id", "book_id", "status", "chunk_idx") == rows(P.player_states(table), "event_id", "book_id", "status", "chunk_idx")
    batches = {f.split("/rows/")[1].split("/")[0] for f in found.where("book_id = 1").inputFiles()}
    assert len(batches) > 2


@pytest.mark.parametrize("few", [3, 50])
def test_a_book_of_many_events_waits_by_span(spark, tmp_path, few):
    table = spark.createDataFrame(events(300, 7), EVENT)
    found = P.drain(P.player_stream(P.in_time_order(table, str(tmp_path / "in"), 3), few=few), str(tmp_path / "out"), "append")
    assert rows(found, "event_id", "book_id", "status", "chunk_idx") == rows(P.player_states(table), "event_id", "book_id", "status", "chunk_idx")


def test_waiting_rows_of_a_book_cost_few_calls(monkeypatch):
    """60 events on 30 days: one timer and one append, however many spans they fall into."""
    calls = []

    class State:
        def __init__(self, *_):
            self.held = None

        def __getattr__(self, name):
            return lambda *a: calls.append(name) or (False if name in ("exists", "containsKey") else None)

    class Handle(State):
        getListState = getMapState = getValueState = State

    class Times:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    player = P.Player()
    player.init(Handle())
    came = [{"at": (d * P.SPAN_MS + k) * 1000, "event_id": 2 * d + k, "action": "play", "chunk_idx": 1} for d in range(1, 31) for k in range(2)]
    assert list(player.handleInputRows((1,), iter(came), Times())) == []
    assert calls.count("registerTimer") == 1 and calls.count("appendList") == 1 and len(calls) < 8


def test_late_events_are_dropped_and_open_ones_wait(spark, tmp_path):
    folder, at = str(tmp_path / "in"), lambda m: START + dt.timedelta(minutes=m)
    for part in ([(1, 4, at(0), 1, "view")], [(1, 5, at(5000), 2, "click")], [(1, 6, at(1), 3, "click"), (1, 7, at(5001), 4, "error")]):
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = P.drain(P.player_stream(stream), str(tmp_path / "out"), "append")
    assert rows(found) == [(1, 1, "playing", 4)]  # event 3 came too late, 2 and 4 wait for a later one


def test_beats_start_when_their_silence_is_over(spark, tmp_path):
    pick = random.Random(5)
    units = [(d, i // 3, i % 3, pick.choice([0, 220, 460, 650, 900]), START + dt.timedelta(milliseconds=d + i * 1500)) for d in range(4) for i in range(40)]
    table = spark.createDataFrame(units, "doc_id long, chunk_idx int, unit int, pause_ms int, ts timestamp")
    found = P.drain(P.beats_stream(P.in_time_order(table, str(tmp_path / "in"))), str(tmp_path / "out"), "append")
    want = table.select("doc_id", "chunk_idx", "unit", "pause_ms", F.timestamp_millis(F.unix_millis("ts") + F.col("pause_ms")).alias("starts_at"))
    assert rows(found, *want.columns) == rows(want)


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_drained_rows_lie_in_the_folder(spark, tmp_path, mode):
    table = spark.createDataFrame(events(40, 2), EVENT)
    stream = P.in_time_order(table, str(tmp_path / "in"), 2)
    made = P.player_stream if mode == "append" else lambda s: P.progress(s).where("book_id is not null")
    want = P.player_states if mode == "append" else P.progress
    found = P.drain(made(stream), str(tmp_path / "out"), mode)
    assert found.inputFiles() and all(str(tmp_path / "out") in f for f in found.inputFiles())
    columns = [c for c in found.columns if c != "updated_at"]
    assert rows(found, *columns) == rows(want(table), *columns)
