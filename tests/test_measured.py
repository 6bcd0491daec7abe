"""Exact quantiles, ranks and sketches against plain computations."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemill.operators import quantiles as q
from tidemill.operators import sketches
from tidemill.session import Scratch


@pytest.fixture(scope="module")
def skewed(spark):
    draw = random.Random(5)
    value = lambda: draw.choice([None, float("nan"), 7.0, 7.0, 7.0, 10.0 ** draw.randrange(-300, 300), -draw.random(), float(draw.randrange(50))])
    rows = [(draw.choice(["hot"] * 6 + ["b", None]), value()) for _ in range(3000)] + [("one", 5.0), ("none", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").selectExpr("*", "1 AS n", "2 AS g", "3 AS rank", "4 AS `a.b`").repartition(4)
    return [(k, v) for k, v in rows if v is not None and v == v], df


@pytest.mark.parametrize(("cuts", "few"), [(4, 2), (64, 4096)])
def test_quantiles_equal_numpy(skewed, cuts, few):
    rows, df = skewed
    wanted = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {r.k: r for r in q.exact_quantiles(df, ["k"], "v", wanted, cuts, few).collect()}
    groups = {k: sorted(v for key, v in rows if key == k) for k, _ in rows}
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        assert got[k].n == len(values)
        for i, p in enumerate(wanted):
            place = p * (len(values) - 1)
            low, high = values[int(place)], values[int(np.ceil(place))]
            assert got[k][f"q{i}"] == low + (high - low) * (place - int(place))


@pytest.mark.parametrize("first", [None, [], [3.0, 7.0], [None]])
def test_discrete_quantiles_equal_sorting_whatever_the_estimates(spark, skewed, first):
    rows, df = skewed
    wanted = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    edges = None if first is None else spark.createDataFrame([("hot", first), (None, first)], "k string, edges array<double>")
    got = {r.k: r for r in q.exact_quantiles(df, ["k"], "v", wanted, 8, 4, discrete=True, first=edges).collect()}
    groups = {k: sorted(v for key, v in rows if key == k) for k, _ in rows}
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        assert [got[k][f"q{i}"] for i in range(6)] == [values[max(math.ceil(round(p * 1000) * len(values) / 1000) - 1, 0)] for p in wanted]


@pytest.fixture(scope="module")
def many_events(spark, tmp_path_factory):
    """More values than a sketch lists, with a type and times of nulls, and repeats."""
    path = str(tmp_path_factory.mktemp("many"))
    number = F.col("id") * 7919 % 1_000_003
    rows = spark.range(600_000, numPartitions=4).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1_704_000_000 + F.col("id") % 40 * 43_200).cast("timestamp_ntz").alias("ts"),
        F.when(number % 50 > 0, number % 150_000 * 1_000_003).alias("user_id"), F.when(number % 7 > 0, F.when(number % 11 > 1, "view").otherwise("buy")).alias("event_type"),
        F.when(number % 5 > 0, F.sqrt(number.cast("double")) - 300).alias("value"))
    only_nulls = rows.limit(3).withColumns({"event_type": F.lit("none"), "value": F.lit(None).cast("double"), "ts": F.lit(None).cast("timestamp_ntz"), "user_id": F.lit(None).cast("long")})
    rows.union(only_nulls).write.parquet(f"{path}/events.parquet")
    return path


def query_equals_sql(spark, name, path):
    want = duckdb.connect().execute(entry.oracle_sql()[name].replace("FROM events", f"FROM '{path}/events.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, entry.queries()[name](spark, path).collect()), key=str) == sorted(want, key=str)


def test_estimates_by_type_are_settled_by_counts(spark, many_events):
    query_equals_sql(spark, "estimates_by_type", many_events)


def test_weeks_of_daily_sketches_are_settled_by_counts(spark, many_events):
    query_equals_sql(spark, "weeks_of_daily_sketches", many_events)


def test_quantiles_of_nothing(skewed):
    _, df = skewed
    assert q.exact_quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0
    assert q.exact_quantiles(df.where("k = 'none'"), [], "v", [0.5]).count() == 0
    assert [tuple(r) for r in q.exact_quantiles(df.where("k = 'one'"), [], "v", [0.5]).collect()] == [(1, 5.0)]
    with pytest.raises(ValueError):
        q.exact_quantiles(df, ["k"], "v", [1.5])


def test_ranks_equal_sorting(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice([None, 3, 3, 3, *range(40)])) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, v int").selectExpr("*", "0 AS rank", "1 AS part", "2 AS `a.b`").repartition(5)
    out = q.global_ranks(df, "v")
    assert sorted(out.columns) == sorted(df.columns)
    assert {r.id: r["rank"] for r in out.collect()} == {i: None if v is None else 1 + sum(x is not None and x < v for _, x in rows) for i, v in rows}
    assert q.global_ranks(df.limit(0), "v").count() == 0


def test_sketches_merge_and_stay_within_their_error(spark):
    n = 200_000
    rows = spark.range(n, numPartitions=6).select((F.col("id") % 8).alias("day"), (F.col("id") * 7919 % 60_000).alias("user"), F.when(F.col("id") % 10 > 0, F.pow(F.rand(3), 5)).alias("v"))
    rows = Scratch(spark, "test").save(rows)
    path = f"{Scratch(spark, 'test').path}/sketches"
    for half in ("day < 5", "day >= 5"):  # days that come later are appended
        sketches.save(sketches.sketched(rows.where(half), {"day": F.col("day")}, F.col("user"), F.col("v")), path)
    assert spark.read.parquet(path).count() == 8
    for where in ("true", "day IN (1, 6)"):
        found = sketches.merged(spark, path, {"all": F.lit(1)}, [0.1, 0.5, 0.99], where).first()
        some = rows.where(where)
        values = np.sort([r.v for r in some.where("v IS NOT NULL").collect()])
        assert found.n == some.count() and abs(found.users / some.select("user").distinct().count() - 1) < 4 * 1.04 / 2**7
        for i, p in enumerate([0.1, 0.5, 0.99]):
            assert abs(np.searchsorted(values, found[f"q{i}"]) / len(values) - p) < 0.004
    assert sketches.merged(spark, path, {"day": F.col("day")}, [0.5], "day > 90").count() == 0
    empty = f"{path}-empty"
    none = rows.where("day = 2 AND v IS NULL")
    sketches.save(sketches.sketched(none, {"day": F.col("day")}, F.lit(None).cast("long"), F.col("v")), empty)
    assert [tuple(r) for r in sketches.merged(spark, empty, {"day": F.col("day")}, [0.5]).collect()] == [(2, none.count(), 0, None)] and none.count() > 0
