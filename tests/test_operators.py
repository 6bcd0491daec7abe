"""Joins, windows and streams on small rows with ties and nulls."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemill.operators.joins import asof_join, interval_join
from tidemill.operators.windows import sessions, top_k
from tidemill.streaming import events as streaming


def test_asof_join_takes_the_last_row_at_or_before(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 5, 3), (None, 5, 4), ("a", None, 5)], "k string, at int, id int")
    right = spark.createDataFrame([("a", 5, 7, "same"), ("a", 5, 6, "less"), ("a", 2, 9, "early"), (None, 1, 1, "null"), ("b", 6, 1, "late")], "k string, at int, id int, v string")
    got = {r.id: r.asof_v for r in asof_join(left, right, ["k"], "at", ["v"], "id").collect()}
    assert got == {1: "same", 2: None, 3: None, 4: None, 5: None}
    assert asof_join(left.limit(0), right, ["k"], "at", ["v"], "id").count() == 0


@pytest.mark.parametrize("width", [None, 1, 7, 1000])
def test_asof_join_equals_brute_force_with_and_without_cells(spark, width):
    draw = random.Random(3)
    some = lambda n: [(draw.choice(["hot"] * 5 + ["a", None]), draw.choice([None, *range(40)]), i) for i in range(n)]
    a, b = some(120), some(60)
    left = spark.createDataFrame([(*r, 1, 2, 3) for r in a], "k string, at int, id int, side int, value int, `a.b` int").repartition(3)
    right = spark.createDataFrame(b, "k string, at int, id int").withColumn("v", F.col("id") * 10)
    cell = None if width is None else F.floor(F.col("at") / width)
    out = asof_join(left, right, ["k"], "at", ["v"], "id", cell)
    assert out.columns == [*left.columns, "asof_v"]
    want = {}
    for k, at, i in a:
        known = [(t, j) for key, t, j in b if None not in (k, at, t) and key == k and t <= at]
        want[i] = max(known)[1] * 10 if known else None
    assert {r.id: r.asof_v for r in out.collect()} == want and len(set(want.values())) > 10


def test_interval_join_of_long_spans_and_clashing_names(spark):
    points = spark.createDataFrame([(1, i * 1000, 5) for i in range(100)] + [(None, 5, 5), (1, None, 5)], "k int, at long, cell int")
    spans = spark.createDataFrame([(1, 0, 100_000, 1), (1, 5, 6, 2), (1, 999, 1001, 3), (1, 40, 40, 4), (None, 0, 9, 5), (1, None, 9, 6), (1, -10**12, 10**12, 7)], "k int, start long, stop long, size int")
    out = interval_join(points, spans, ["k"], "at", "start", "stop", 1)
    assert out.columns == ["k", "at", "cell", "start", "stop", "size"]
    assert {r["size"]: r["count"] for r in out.groupBy("size").count().collect()} == {1: 100, 3: 1, 7: 100}
    assert interval_join(points, spans.limit(0), ["k"], "at", "start", "stop", 1).count() == 0


@pytest.mark.parametrize("cell", [1, 10, 86400])
def test_sessions_equal_brute_force(spark, cell):
    draw = random.Random(4)
    rows = [(draw.choice(["hot"] * 5 + ["a", None]), draw.choice([None] * 20 + [*range(300)]), i, 0, 0) for i in range(150)]
    docs = spark.createDataFrame(rows, "k string, at int, id int, fresh int, session int").repartition(3)
    out = sessions(docs, "k", F.col("at"), "id", 8, cell_seconds=cell)
    last, number, want = {}, {}, {}
    for k, at, i, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        if k not in number or at is not None and (last[k] is None or at - last[k] > 8):
            number[k] = number.get(k, 0) + 1
        last[k], want[i] = at, number[k]
    assert {r.id: r.session for r in out.collect()} == want and sorted(out.columns) == sorted(docs.columns)
    assert sessions(docs.limit(0), "k", F.col("at"), "id", 8).count() == 0


def test_interval_join_of_open_spans(spark):
    least, most = -(2**63), 2**63 - 1
    spans = [(1, -5, most, 1), (1, least, 0, 2), (1, least, most, 3), (1, most - 1, most, 4), (1, least, least + 1, 5)]
    points = [(1, x) for x in (least, -6, -5, 0, 5, 2**62, most - 1, most)]
    out = interval_join(spark.createDataFrame(points, "k int, at long"), spark.createDataFrame(spans, "k int, start long, stop long, n int"), ["k"], "at", "start", "stop", 1)
    assert sorted((r.at, r.n) for r in out.collect()) == sorted((x, n) for _, x in points for _, a, b, n in spans if a <= x < b)


def test_rows_of_sessions_and_asof_joins_shuffle_once(spark, sf_dir):
    """Exchanges of rows, which are packed, as against those of cells."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))
    for out in (sessions(events, "user_id", F.col("at"), "event_id", 3600), asof_join(events, events, ["user_id"], "at", ["value"], "event_id", F.to_date("ts"))):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        exchanges = [line for line in plan.splitlines() if re.search(r"(?<!Reused)(?<!Broadcast)Exchange hashpartitioning", line)]
        reads = [line for line in plan.splitlines() if "FileScan parquet" in line]
        assert len(exchanges) <= 4 and len(reads) <= 4, plan


def test_interval_join_equals_brute_force(spark):
    points = [(i % 3, i * 7 % 100) for i in range(60)]
    spans = [(i % 3, i * 11 % 90, i * 11 % 90 + i) for i in range(30)]
    got = interval_join(spark.createDataFrame(points, "k int, at int"), spark.createDataFrame(spans, "k int, start int, stop int"), ["k"], "at", "start", "stop", 10)
    want = sorted((k, at, a, b) for k, at in points for key, a, b in spans if k == key and a <= at < b)
    assert sorted(map(tuple, got.select("k", "at", "start", "stop").collect())) == want


def test_top_k_and_sessions(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 5), ("a", 3, 100), ("b", 4, 3), ("b", 5, 3)], "k string, id int, at int")
    assert {(r.k, r.id) for r in top_k(rows, ["k"], [F.desc("at"), F.col("id")], 1).collect()} == {("a", 3), ("b", 4)}
    assert {r.id: r.session for r in sessions(rows, "k", F.col("at"), "id", 10).collect()} == {1: 1, 2: 1, 3: 2, 4: 1, 5: 1}


def test_stream_equals_batch_for_closed_windows(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    source, out, again = (str(tmp_path / n) for n in ("in", "out", "again"))
    batch.repartition(3).write.parquet(source)
    schema = ", ".join(f"{n} {k}" for n, k in batch.dtypes)
    for _ in range(2):  # a second run finds nothing new
        streaming.to_files(streaming.window_counts(streaming.read_events(spark, source, schema)), out, str(tmp_path / "check")).awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(out).collect()}
    hours = batch.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour").start.alias("start"), "event_type").count().collect()
    want = {(r.start, r.event_type): r["count"] for r in hours}
    closed = max(start for start, _ in got)
    assert got == {k: n for k, n in want.items() if k[0] <= closed} and len(got) > 0.9 * len(want)
    twice = batch.union(batch)
    twice.write.parquet(again)
    streaming.to_files(streaming.distinct_events(streaming.read_events(spark, again, schema)), f"{out}2", str(tmp_path / "check2")).awaitTermination()
    assert spark.read.parquet(f"{out}2").count() == batch.count()
