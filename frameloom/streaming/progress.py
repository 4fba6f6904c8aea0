"""Progress of live sources: the latest counter, and watches that end in a stall, a deadline or the source's end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .live import framed, sorted_rows

WATCHES = "source_id string, run int, started long, progressed long, ended long, counter long, status string"
WATCH_STATE = "run int, started long, progressed long, seen long, counter long, watched boolean"


def latest(rows: DataFrame) -> DataFrame:
    """The largest counter a source has shown; a smaller one never takes it back. Streams in update mode, with state encoded as ``unsaferow``: it is Spark's own aggregate."""
    return rows.groupBy("source_id").agg(F.max("counter").alias("counter"))


class Watches(StatefulProcessor):
    """Times are microseconds. Only a counter above the largest so far is an advance; it alone puts a stall off, and it alone opens the next watch."""

    def __init__(self, stall: int, total: int) -> None:
        self.stall, self.total = stall, total

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("watch", WATCH_STATE)

    def _limit(self, started: int, progressed: int) -> tuple[int, str]:
        stalled, late = progressed + self.stall, started + self.total
        return (late, "deadline") if late <= stalled else (stalled, "stall")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run, started, progressed, seen, counter, watched = self.state.get() or (0, 0, 0, None, None, False)
        out = []

        def close(at: int, status: str) -> None:
            out.append({"source_id": key[0], "run": run, "started": started, "progressed": progressed, "ended": at, "counter": counter, "status": status})

        for row in sorted_rows(rows, ["us", "is_end", "counter"]):
            now = int(row["us"]) if seen is None else max(seen, int(row["us"]))  # time does not go back
            if watched and now >= self._limit(started, progressed)[0]:
                close(*self._limit(started, progressed))
                watched = False
            advance = not pd.isna(row["counter"]) and (counter is None or row["counter"] > counter)
            counter = int(row["counter"]) if advance else counter
            if advance and not watched:
                run, started, watched = run + 1, now, True
            if watched:
                progressed = now if advance else progressed
                if row["is_end"]:
                    close(now, "finished")
                    watched = False
            seen = now
        self.state.update((run, started, progressed, seen, counter, watched))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if watched:
            self.handle.registerTimer(-(-self._limit(started, progressed)[0] // 1000))
        yield from framed(out, WATCHES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run, started, progressed, seen, counter, watched = self.state.get()
        ended, status = self._limit(started, progressed)
        if watched and 1000 * expiredTimerInfo.getExpiryTimeInMs() >= ended:
            self.state.update((run, started, progressed, max(seen, ended), counter, False))
            yield from framed([{"source_id": key[0], "run": run, "started": started, "progressed": progressed, "ended": ended, "counter": counter, "status": status}], WATCHES)

    def close(self) -> None:
        pass


def watches(stream: DataFrame, *, stall_us: int, total_us: int, delay: str) -> DataFrame:
    """What became of each watch over a live source: finished, or given up while the source was silent (stall) or took too long (deadline).

    ``stream``: source_id, ts, counter, is_end. A watch begins with a source's first counter, and the next one with the first advance
    after one has ended. It ends with an end row; ``stall_us`` after its last advance, however many repeated or smaller counters come meanwhile; or
    ``total_us`` after it began (a row at the very limit is too late). Stalls and deadlines are event-time timers: they are put out
    as soon as the watermark passes them, not when the source shows up again. Rows older than the watermark are late for the stream and left out by Spark.
    """
    timed = stream.select("source_id", "ts", F.unix_micros("ts").alias("us"), F.col("counter").cast("long").alias("counter"), "is_end").withWatermark("ts", delay)
    return timed.groupBy("source_id").transformWithStateInPandas(Watches(stall_us, total_us), WATCHES, "append", "eventTime")
