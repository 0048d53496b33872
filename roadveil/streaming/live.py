"""Streams that keep state: searches that wait for a pause, positions that are watched, loads whose progress is told.

Each has a form for tables, which says what the stream's rows are once all of them have come. The processors need the
RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

#: fixed value: milliseconds without a position until the watch counts as lost
LOST_AFTER = 30_000
WATCHED = "user_id long, at_ms long, event_id long, what string"
PROGRESS = "load_id long, chunk long, loaded long, percent long"


def debounced(requests: DataFrame, pause: str = "1800 seconds") -> DataFrame:
    """``requests(user_id, event_id, ts)`` -> ``(user_id, event_id, n, fired_us)``: a user's last request of a run without a pause, when it
    fires, and of how many. A request at the very end of the pause begins a new run.

    The same for a table and for a stream with a watermark on ``ts``, whose rows come once the watermark has passed their firing.
    """
    run = F.session_window("ts", pause)
    last = F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id")
    found = requests.groupBy("user_id", run.alias("run")).agg(last, F.count("*").alias("n"))
    return found.select("user_id", "event_id", "n", F.unix_micros(F.col("run.end").cast("timestamp")).alias("fired_us"))


def positions(events: DataFrame) -> DataFrame:
    """``events(user_id, event_id, ts)`` with ``at_ms``; timers count milliseconds."""
    ts = F.col("ts").cast("timestamp")
    return events.select("user_id", "event_id", ts.alias("ts"), F.floor(F.unix_micros(ts) / 1000).cast("long").alias("at_ms"))


def watched(fixes: DataFrame, lost_after: int = LOST_AFTER) -> DataFrame:
    """``fixes(user_id, event_id, at_ms)`` -> ``WATCHED``: every position (``fix``), and ``lost`` where none follows in time."""
    following = F.lead("at_ms").over(Window.partitionBy("user_id").orderBy("at_ms", "event_id"))
    marked = fixes.withColumn("lost", following.isNull() | (following > F.col("at_ms") + lost_after))
    fix = F.struct("at_ms", F.lit("fix").alias("what"))
    lost = F.struct((F.col("at_ms") + lost_after).alias("at_ms"), F.lit("lost").alias("what"))
    each = marked.select("user_id", "event_id", F.explode(F.when(F.col("lost"), F.array(fix, lost)).otherwise(F.array(fix))).alias("e"))
    return each.select("user_id", "e.at_ms", "event_id", "e.what")


class Watch(StatefulProcessor):
    """The newest position of a user and a timer behind it. A position that comes after a newer one is passed over; when the timer ends, the
    state goes, since whatever could still follow within it is behind the watermark."""

    def __init__(self, lost_after: int = LOST_AFTER):
        self.lost_after = lost_after

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at_ms long, event_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = np.concatenate([r[["at_ms", "event_id"]].to_numpy(np.int64) for r in rows])
        came = came[np.lexsort((came[:, 1], came[:, 0]))]
        old = self.newest.get() if self.newest.exists() else None
        if old is not None:
            came = came[(came[:, 0] > old[0]) | ((came[:, 0] == old[0]) & (came[:, 1] > old[1]))]
        if not len(came):
            return
        before = came[:-1] if old is None else np.vstack([np.array([old], np.int64), came[:-1]])
        gone = before[came[len(came) - len(before) :, 0] > before[:, 0] + self.lost_after]
        self.newest.update((int(came[-1, 0]), int(came[-1, 1])))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(came[-1, 0]) + self.lost_after)
        yield self.told(key, came, "fix", 0)
        if len(gone):
            yield self.told(key, gone, "lost", self.lost_after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists():
            last = np.array([self.newest.get()], np.int64)
            self.newest.clear()
            yield self.told(key, last, "lost", self.lost_after)

    @staticmethod
    def told(key, rows: np.ndarray, what: str, later: int) -> pd.DataFrame:
        return pd.DataFrame({"user_id": key[0], "at_ms": rows[:, 0] + later, "event_id": rows[:, 1], "what": what})

    def close(self) -> None:
        pass


def watched_stream(fixes: DataFrame, late: str = "0 seconds", lost_after: int = LOST_AFTER) -> DataFrame:
    """``watched`` for a stream of ``positions``, in append mode. What is ``late`` by more than that behind the newest of all is dropped. The
    numbers of one user that came within one batch are in one task's memory, 16 bytes each; a trigger's size bounds them."""
    known = fixes.withWatermark("ts", late)
    return known.groupBy("user_id").transformWithStateInPandas(Watch(lost_after), WATCHED, "append", "eventtime")


def progress(chunks: DataFrame) -> DataFrame:
    """``chunks(load_id, chunk, size, total)`` -> ``PROGRESS``: what is loaded with each chunk, numbered from 0, repeats once. Nothing follows a
    chunk that is missing."""
    once = chunks.groupBy("load_id", "chunk").agg(F.min(F.struct("size", "total")).alias("c"))
    order = Window.partitionBy("load_id").orderBy("chunk")
    summed = once.withColumns({"n": F.row_number().over(order) - 1, "loaded": F.sum("c.size").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    percent = F.when(F.col("c.total") > 0, F.floor(F.col("loaded") * 100 / F.col("c.total")))
    return summed.filter("n = chunk").select("load_id", "chunk", F.col("loaded").cast("long").alias("loaded"), percent.cast("long").alias("percent"))


class Progress(StatefulProcessor):
    """How many chunks of a load are there and their size; chunks that came early wait in a map of their own."""

    def init(self, handle) -> None:
        self.done = handle.getValueState("done", "chunks long, loaded long")
        self.early = handle.getMapState("early", "chunk long", "size long, total long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count, loaded = map(int, self.done.get()) if self.done.exists() else (0, 0)
        for part in rows:
            for chunk, size, total in part.sort_values(["chunk", "size", "total"])[["chunk", "size", "total"]].itertuples(index=False):
                if chunk >= count and not self.early.containsKey((int(chunk),)):
                    self.early.updateValue((int(chunk),), (int(size), int(total)))
        told = []
        while self.early.containsKey((count,)):
            size, total = self.early.getValue((count,))
            self.early.removeKey((count,))
            loaded += size
            told.append((key[0], count, loaded, loaded * 100 // total if total else None))
            count += 1
        if told:
            self.done.update((count, loaded))
            frame = pd.DataFrame(told, columns=["load_id", "chunk", "loaded", "percent"])
            yield frame.astype({"percent": "Int64"})

    def close(self) -> None:
        pass


def progress_stream(chunks: DataFrame) -> DataFrame:
    """``progress`` for a stream of chunks in any order, in append mode. A load keeps 16 bytes, so that repeats are known ever after."""
    return chunks.groupBy("load_id").transformWithStateInPandas(Progress(), PROGRESS, "append", "none")
