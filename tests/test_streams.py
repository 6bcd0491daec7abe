"""State with timers, joins of streams and the keyed sink: late rows, restarts and replays."""

import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemill.streaming import events as streaming
from tidemill.streaming import sessions
from tidemill.streaming.sessions import closed_sessions, followed, rocks
from tidemill.streaming.sink import KeyedSink

SCHEMA = "user string, ts timestamp, value double, id long"
SECOND = 1_000_000


def files(spark, folder, batches):
    """One file for each batch, in order of time."""
    for i, rows in enumerate(batches):
        made = spark.createDataFrame(rows, "user string, at long, value double, id long")
        made.select("user", F.timestamp_micros("at").alias("ts"), "value", "id").coalesce(1).write.parquet(f"{folder}/{i}")
        for name in os.listdir(f"{folder}/{i}"):
            os.utime(f"{folder}/{i}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def closed(rows, gap, until):
    """Sessions of (user, at, value) that end by the gap before `until`, in microseconds."""
    out = []
    for user in {r[0] for r in rows}:
        spans = []
        for at, value in sorted((at, value or 0.0) for u, at, value, _ in rows if u == user and at is not None):
            if spans and at - spans[-1][1] <= gap:
                spans[-1] = [spans[-1][0], at, spans[-1][2] + 1, spans[-1][3] + value]
            else:
                spans.append([at, at, 1, value])
        out += [(user, *s) for s in spans if s[1] // 1000 + gap // 1000 + 1 <= until // 1000]
    return sorted(out, key=str)


def test_sessions_with_late_rows_and_a_restart(spark, tmp_path):
    draw = random.Random(7)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    base, batches = 1_700_000_000, []
    for b in range(6):  # each batch spans 200 seconds, and comes up to 100 seconds out of order
        batches.append([(draw.choice(["hot", "hot", "a", None]), (base + b * 200 + draw.randrange(-100, 200)) * SECOND, draw.choice([1.0, 2.0, None]), i) for i in range(25)])
    batches[2].append(("a", None, 1.0, 99))
    late = [("a", (base - 5000) * SECOND, 1.0, 100), ("hot", (base - 4000) * SECOND, 1.0, 101)]
    batches[4] += late
    files(spark, source, batches[:3])
    dropped = 0
    for more in (None, batches[3:]):  # the second run goes on where the first one stopped
        if more:
            for i, rows in enumerate(more, 3):
                files(spark, f"{source}/../more{i}", [rows])
                os.rename(f"{source}/../more{i}/0", f"{source}/{i}")
                for name in os.listdir(f"{source}/{i}"):
                    os.utime(f"{source}/{i}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
        with rocks(spark):
            query = streaming.to_files(closed_sessions(stream(spark, source), "user", "value", 30_000, "120 seconds"), out, state)
            query.awaitTermination()
        dropped += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    kept = [r for rows in batches for r in rows if r not in late]
    until = max(at for _, at, _, _ in kept if at is not None) - 120 * SECOND
    got = sorted(((r.key, r.start, r["last"], r.n, r.total) for r in spark.read.parquet(out).collect()), key=str)
    assert got == closed(kept, 30 * SECOND, until) and len(got) > 10
    assert dropped == len(late)
    query.stop()


class Calls:
    """State and timers of one key, and how often they were called."""

    def __init__(self):
        self.rows, self.timers, self.n = [], [], 0

    def called(self):
        self.n += 1
        return self

    def getListState(self, *_):  # noqa: N802
        return self

    def exists(self):
        return bool(self.called().rows)

    def get(self):
        return iter(self.called().rows)

    def put(self, rows):
        self.called().rows = rows

    def clear(self):
        self.put([])

    def listTimers(self):  # noqa: N802
        return iter(list(self.called().timers))

    def registerTimer(self, at):  # noqa: N802
        self.called().timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.called().timers.remove(at)

    def getExpiryTimeInMs(self):  # noqa: N802
        return min(self.timers)


class Watermark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at


def test_calls_to_state_dont_grow_with_sessions(monkeypatch):
    monkeypatch.setattr(sessions, "AT_ONCE", 7)
    draw, state = random.Random(9), Calls()
    sessions_of = sessions.Sessions(1000)
    sessions_of.init(state)
    rows = [("a", draw.randrange(10_000) * SECOND, draw.choice([1.0, None]), k) for k in range(3000)]
    made, got, seen = streaming_rows(rows), [], []
    for k, until in enumerate((4000, 9000, 30_000)):  # seconds; rows of a batch come in any order
        some = [r for r in made if k * 4000 <= r.at // SECOND < (k + 1) * 4000]
        seen += some
        before = state.n
        list(sessions_of.handleInputRows(("a",), iter(some), Watermark(0)))
        assert state.n - before < 6 and len(state.timers) == 1
        while state.timers and min(state.timers) <= until * 1000:
            before, at = state.n, min(state.timers)
            got += list(sessions_of.handleExpiredTimer(("a",), Watermark(until * 1000), state))
            state.timers.remove(at)  # as Spark does with one that has fired
            assert state.n - before < 6
        assert sorted(((r.key, r.start, r["last"], r.n, r.total) for r in got), key=str) == closed([("a", r.at, r.value, 0) for r in seen], SECOND, until * SECOND)
    assert len(got) > 1000 and not state.rows and not state.timers


def streaming_rows(rows):
    made = [Row(key=u, ts=None, at=at, value=value) for u, at, value, _ in rows]
    random.Random(10).shuffle(made)
    return made


def test_joined_streams_equal_batch(spark, tmp_path):
    draw = random.Random(8)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [(draw.choice(["a", "b", None]), (1_700_000_000 + k * 60) * SECOND, 0.0, k) for k in range(120)]
    rows += [("a", (1_700_000_000 + 60) * SECOND, 0.0, 500), ("a", None, 0.0, 501)]
    files(spark, source, [rows[:50], rows[50:]])
    events = stream(spark, source)
    first, then = events.where("id % 3 = 0").select("user", "ts", "id"), events.where("id % 3 = 1").select("user", "ts", "id")
    pairs = followed(first, then, "user", "10 MINUTES", "1 hour").select("first_id", "then_id")
    streaming.to_files(pairs, out, state).awaitTermination()
    one, two = ([r for r in rows if r[3] % 3 == k and None not in r[:2]] for k in (0, 1))
    want = sorted((a[3], b[3]) for a in one for b in two if a[0] == b[0] and 0 <= b[1] - a[1] <= 600 * SECOND)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want and len(want) > 20


@pytest.fixture
def sink(tmp_path):
    return KeyedSink(f"file://{tmp_path}/sink", "k string, v long, at long, part string", "part", ["k"], ["at"])


def rows_of(sink, spark, upto=None):
    found = sink.read(spark, upto)
    return None if found is None else sorted((tuple(r) for r in found.select("k", "v", "at", "part").collect()), key=str)


def test_a_replayed_batch_changes_nothing(spark, sink):
    make = lambda rows: spark.createDataFrame(rows, "k string, v long, at long, part string")
    assert rows_of(sink, spark) is None and sink.vacuum(spark) == 0
    one, two = make([("a", 1, 5, "x"), ("a", 2, 4, "x"), (None, 3, 1, "x"), ("b", 9, 1, "y"), ("n", 1, 1, None)]), make([("a", 7, 6, "x"), (None, 8, 0, "x"), ("c", 1, 1, "z"), ("n", 2, 2, None)])
    first = sorted([("a", 1, 5, "x"), (None, 3, 1, "x"), ("b", 9, 1, "y"), ("n", 1, 1, None)], key=str)
    last = sorted([("a", 7, 6, "x"), (None, 3, 1, "x"), ("b", 9, 1, "y"), ("c", 1, 1, "z"), ("n", 2, 2, None)], key=str)
    for _ in range(2):
        sink.upsert(one, 0)
        assert rows_of(sink, spark) == first
    for _ in range(3):
        sink.upsert(two, 1)
        assert rows_of(sink, spark) == last and rows_of(sink, spark, 0) == first
    sink.upsert(two.limit(0), 2)
    assert rows_of(sink, spark) == last
    assert sink.vacuum(spark) == 2 and rows_of(sink, spark) == last and sink.vacuum(spark) == 0


def test_a_batch_that_broke_off_is_not_seen(spark, sink, monkeypatch):
    make = lambda rows: spark.createDataFrame(rows, "k string, v long, at long, part string")
    sink.upsert(make([("a", 1, 1, "x")]), 0)
    path, sink.path = sink.path, sink.path
    broken = KeyedSink(path, sink.schema, "part", ["k"], ["at"])
    monkeypatch.setattr(type(spark), "range", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        broken.upsert(make([("a", 2, 2, "x"), ("b", 1, 1, "y")]), 1)
    monkeypatch.undo()
    assert rows_of(sink, spark) == [("a", 1, 1, "x")]
    sink.upsert(make([("a", 2, 2, "x"), ("b", 1, 1, "y")]), 1)  # it comes again
    assert rows_of(sink, spark) == [("a", 2, 2, "x"), ("b", 1, 1, "y")]
