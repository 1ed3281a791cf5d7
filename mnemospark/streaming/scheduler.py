"""When the queued turns of sessions are processed: the same fold in a batch and, with list state and timers, in a stream.

A turn is queued first. Its session is processed then if the turn is one of its first (WARM_UP), if the queue is long, or
if its last processing is idle seconds ago. A queue that waits is flushed idle seconds after the last processing, whether
or not another turn comes. Every item is emitted once, with the turn that flushed it or none, and why.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import IDLE, QUEUE, WARM_UP

FLUSHES = "session long, n long, at double, reason string, items array<long>"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fold(turns: list[tuple[float, int]], seen: int, last: float | None, waiting: list[int], queue: int, idle: float) -> tuple[list[tuple], int, float | None, list[int]]:
    """Flushes (n, at, reason, items) that turns (at, n) in order make, and the state after them."""
    out, waiting = [], list(waiting)
    for at, n in turns:
        seen, last = seen + 1, at if last is None else last
        if waiting and at - last >= idle:
            out.append((None, last + idle, "idle", waiting))
            waiting = []
        waiting.append(n)
        reason = "warm-up" if seen in WARM_UP else "queue" if len(waiting) >= queue else "pause" if at - last >= idle else None
        if reason:
            out.append((n, at, reason, waiting))
            last, waiting = at, []
    return out, seen, last, waiting


def _frame(session, out: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame([(session, *row) for row in out], columns=["session", "n", "at", "reason", "items"])
    return frame.astype({"n": "Int64"})


def flushes(turns: DataFrame, queue: int = QUEUE, idle: float = IDLE, until: float | None = None) -> DataFrame:
    """(session, n, at, reason, items) for turns (session, n, at in seconds); queues that wait are flushed up to the time until, or all.

    A session is one group: what a turn does depends on those before it.
    """

    def whole(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "n"])
        out, _, last, waiting = fold(list(zip(pdf["at"], pdf["n"], strict=True)), 0, None, [], queue, idle)
        if waiting and (until is None or last + idle <= until):
            out.append((None, last + idle, "idle", waiting))
        return _frame(key[0], out)

    return turns.select("session", "n", "at").groupBy("session").applyInPandas(whole, FLUSHES)


class Scheduler(StatefulProcessor):
    """A session's number of turns, its last processing, its waiting items, and a timer for them."""

    def __init__(self, queue: int, idle: float):
        self.most, self.idle = queue, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "turns long, last double")
        self.queue = handle.getListState("queue", "n long")

    def _waiting(self) -> list[int]:
        return [row[0] for row in self.queue.get()] if self.queue.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["seconds", "n"])
        seen, last = self.progress.get() if self.progress.exists() else (0, None)
        out, seen, last, waiting = fold(list(zip(pdf["seconds"].tolist(), pdf["n"].tolist(), strict=True)), seen, last, self._waiting(), self.most, self.idle)
        self.progress.update((seen, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if waiting:
            self.queue.put([(n,) for n in waiting])
            self.handle.registerTimer(int((last + self.idle) * 1000))
        else:
            self.queue.clear()
        if out:
            yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = self._waiting()
        if waiting:
            self.queue.clear()
            yield _frame(key[0], [(None, self.progress.get()[1] + self.idle, "idle", waiting)])

    def close(self) -> None:
        pass


def flushes_of_stream(turns: DataFrame, queue: int = QUEUE, idle: float = IDLE, late: str = "0 seconds") -> DataFrame:
    """The flushes of a stream of turns (session, n, at as a timestamp): an idle queue is flushed when event time has passed it.

    Turns of one session may be out of order within a batch, and by as much as late between batches; later ones are
    dropped by the watermark. Needs the state store of ROCKS, which is set.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = turns.withWatermark("at", late).select("session", "n", "at", (F.unix_micros("at") / 1e6).alias("seconds"))
    return timed.groupBy("session").transformWithStateInPandas(Scheduler(queue, idle), outputStructType=FLUSHES, outputMode="Append", timeMode="EventTime")


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session, n): the items that a stopped stream's queues still hold, from its state."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "queue").load()
    return state.select(F.col("key.session").alias("session"), F.col("list_element.n").alias("n"))


def flushed(items: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The first most waiting items by session and number, and the leftovers: a bounded flush drops nothing."""
    now = items.orderBy("session", "n").limit(most)
    return now, items.join(now, ["session", "n"], "left_anti")
