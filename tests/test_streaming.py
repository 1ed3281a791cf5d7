"""A stream gives what the batch gives."""

import pytest
from pyspark.sql import functions as F

from mnemospark.plans.tables import table
from mnemospark.streaming import scheduler, transcripts, windows
from oracle import DATA


def streamed(spark, tmp_path, df, parts=3):
    df.repartition(parts).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_reducer(spark, tmp_path):
    events = transcripts.as_events(table(spark, f"{DATA}/sf0.001", "conversations"))
    out = transcripts.reduced(streamed(spark, tmp_path, events))
    q = out.writeStream.format("memory").queryName("reduced").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("reduced").collect())) == sorted(map(tuple, transcripts.reduced(events).collect()))


@pytest.mark.parametrize("kind", ["panes", "sessions"])
def test_windows(spark, tmp_path, kind):
    events = table(spark, f"{DATA}/sf0.001", "events")
    work = (lambda e: windows.panes(e, "1 hour", late="60 days")) if kind == "panes" else (lambda e: windows.sessions(e, "2 hours", late="60 days"))
    q = work(streamed(spark, tmp_path, events)).writeStream.format("memory").queryName(kind).outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table(kind).collect())) == sorted(map(str, work(events).collect()))


def test_scheduler_flushes_idle_sessions_and_drops_nothing(spark, tmp_path):
    # Session 0 falls silent with a queue; session 1 pauses; session 2 is dense; session 9 only moves event time.
    rows = [(0, n, 40.0 * n) for n in range(10)] + [(1, n, 40.0 * n + (1000.0 if n > 12 else 0.0)) for n in range(30)] + [(2, n, 5.0 * n) for n in range(200)] + [(9, 0, 100.0), (9, 1, 101.0), (9, 2, 3000.0), (9, 3, 5000.0), (9, 4, 5001.0)]
    rows = [(s, n, 10_000.0 + at) for s, n, at in rows]
    turns = spark.createDataFrame(rows, "session long, n long, at double")
    for low, high in ((0.0, 300.0), (300.0, 900.0), (900.0, 4000.0), (4000.0, 6000.0)):  # a file of each, read in order
        turns.where(f"at >= {10_000 + low} and at < {10_000 + high}").withColumn("at", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session long, n long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = scheduler.flushes_of_stream(stream, 6, 300.0).writeStream.format("memory").queryName("flushes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    plain = lambda df: sorted((r.session, -1 if r.n is None else r.n, round(r["at"], 3), r.reason, tuple(r["items"])) for r in df.collect())
    got = plain(spark.table("flushes"))
    want = plain(scheduler.flushes(turns, 6, 300.0, until=15_001.0))
    assert got == want
    assert (0, -1, 10_580.0, "idle", (8, 9)) in got and {r[3] for r in got} == {"warm-up", "queue", "pause", "idle"}
    # What still waits is in the state: every item is flushed once or waits.
    left = scheduler.waiting(spark, str(tmp_path / "cp"))
    items = sorted((r[0], i) for r in got for i in r[4]) + sorted(map(tuple, left.collect()))
    assert sorted(items) == sorted((s, n) for s, n, _ in rows) and left.count() > 0


def test_bounded_flush_returns_leftovers(spark):
    items = spark.createDataFrame([(s, n) for s in (2, 1) for n in range(4)], "session long, n long")
    now, rest = scheduler.flushed(items, 5)
    assert sorted(map(tuple, now.collect())) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)] and sorted(map(tuple, rest.collect())) == [(2, 1), (2, 2), (2, 3)]
    assert scheduler.flushed(items, 100)[1].count() == 0


def test_confirming_sink_survives_a_batch_that_runs_again(spark, tmp_path):
    events = table(spark, f"{DATA}/sf0.001", "events")
    write = windows.confirming_sink(str(tmp_path / "out"))
    half = events.where("event_id % 2 = 0")
    write(half, 0)
    write(half, 0)
    write(events.where("event_id % 2 = 1"), 1)
    got = windows.confirmed(spark.read.parquet(str(tmp_path / "out")))
    want = windows.confirmed(events.groupBy("user_id", "event_type").agg({"event_id": "min", "*": "count"}).toDF("user_id", "event_type", "first", "n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
