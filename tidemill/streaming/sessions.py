"""Sessions as a stream with state and timers of its own, and a join of two streams by key and time.

A session of a key is closed once the watermark has passed its last event by the gap: a timer of that time emits it, and its state goes. A key has one timer, for the
first session to end, which emits all that have ended: calls to the state are some for a key and batch, and not for each session. State is a list
of a key's open sessions (start, last event, events, sum), not of events. Open sessions lie within the watermark's delay and two gaps of one another, so they are few
for any number of events. Events may come in any order within the delay, and can join two open sessions; Spark drops later ones and counts them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Events of a key that are merged into its sessions at once.
AT_ONCE = 16_384


class Sessions(StatefulProcessor):
    """Merges events (at, in microseconds, and value) into open sessions, and emits closed ones."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, last long, n long, total double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = [tuple(r) for r in self.open.get()]
        merged, events = held, ((at, at, 1, value or 0.0) for _, _, at, value in rows)
        while some := list(islice(events, AT_ONCE)):  # a hot key's events aren't held at once
            merged = self._merged(merged + some)
        self.open.put([Row(start=a, last=b, n=n, total=t) for a, b, n, t in merged])
        before, now = self._next(held), self._next(merged)
        if before != now:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(now)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        # all sessions that the watermark has passed go at once
        now, held = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), [tuple(r) for r in self.open.get()]
        left = [s for s in held if self._ends(s[1]) > now]
        if left:
            self.open.put([Row(start=a, last=b, n=n, total=t) for a, b, n, t in left])
            self.handle.registerTimer(self._next(left))
        else:
            self.open.clear()
        for start, last, n, total in held:
            if self._ends(last) <= now:
                yield Row(key=key[0], start=start, last=last, n=n, total=total)

    def _merged(self, spans: list[tuple]) -> list[tuple]:
        """Spans with those joined that lie no more than the gap apart, by start."""
        merged: list[tuple] = []
        for start, last, n, total in sorted(spans):
            if merged and start - merged[-1][1] <= self.gap_ms * 1000:
                a, b, m, t = merged[-1]
                merged[-1] = (a, max(b, last), m + n, t + total)
            else:
                merged.append((start, last, n, total))
        return merged

    def _next(self, spans: list[tuple]) -> int | None:
        """When the first of a key's sessions ends, the time of its one timer."""
        return min((self._ends(last) for _, last, *_ in spans), default=None)

    def _ends(self, last: int) -> int:
        return last // 1000 + self.gap_ms + 1

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep state in RocksDB, which state of one's own needs."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def closed_sessions(events: DataFrame, key: str, value: str, gap_ms: int, late: str = "10 minutes") -> DataFrame:
    """key, start and last (microseconds), n and total of each session that the watermark has passed by the gap, by event time ts.

    Defined results: a null key is a key like any other; events with a null time are dropped, null values count as 0; ties in time are of one
    session, as are events exactly the gap apart; repeated events count each; events behind the watermark are dropped and counted in the stream's progress.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.where("ts IS NOT NULL").withWatermark("ts", late).select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("at"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").transformWithState(Sessions(gap_ms), f"key {kind}, start long, last long, n long, total double", "Append", "EventTime")


def followed(first: DataFrame, then: DataFrame, key: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Pairs of two streams with equal keys where the second comes at or after the first, and by at most `within`: columns first_ and then_ of each.

    Both sides have a watermark, and a pair's times bound one another, so that Spark drops state that can't match any more.

    Defined results: null keys and times match nothing; ties in time match; repeated rows each give their pairs; rows behind the watermark are dropped.
    """
    a = first.withColumnsRenamed({c: f"first_{c}" for c in first.columns}).withWatermark("first_ts", late)
    b = then.withColumnsRenamed({c: f"then_{c}" for c in then.columns}).withWatermark("then_ts", late)
    near = F.expr(f"then_ts >= first_ts AND then_ts <= first_ts + INTERVAL {within}")
    return a.join(b, (F.col(f"first_{key}") == F.col(f"then_{key}")) & near)
