"""Rows before each row, and values at regular times, against brute force, with ties, nulls and a hot key."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.operators.preceding import preceding, resampled


@pytest.mark.parametrize("reach,cell", [(1, 1), (2, 3), (5, 2), (3, 1000)])
def test_preceding_equals_brute_force(spark, reach, cell):
    draw = random.Random(reach)
    rows = [(draw.choice(["hot"] * 6 + ["a", None]), draw.choice([None, *range(60)]), i, draw.choice([None, i * 2]), 0, 0) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, at int, id int, v int, number int, `a.b` int").repartition(3)
    out = preceding(df, ["k"], F.col("at"), F.col("id"), ["id", "v"], reach, F.floor(F.col("at") / cell))
    assert sorted(out.columns) == sorted([*df.columns, "before"])
    seen, want = defaultdict(list), {}
    for k, _, i, v, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        want[i] = (len(seen[k]) + 1, seen[k][-reach:])
        seen[k].append((i, v))
    assert {r.id: (r.number, [tuple(b) for b in r.before]) for r in out.collect()} == want
    assert preceding(df.limit(0), ["k"], F.col("at"), F.col("id"), ["v"], reach, F.col("at")).count() == 0


def test_halos_shuffle_few_rows(spark):
    """Rows are dealt once; counts are combined, and last rows of cells are chosen, before the shuffle."""
    df = spark.range(10_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"))
    out = preceding(df, ["k"], F.col("at"), F.col("at"), ["at"], 2, F.floor(F.col("at") / 1000))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(dealt") == 3
    assert "partial_count(1)" in plan and plan.count("WindowGroupLimit") == 2  # one on each side of the exchange


@pytest.mark.parametrize("cell", [7, 100_000])
def test_resampled_equals_brute_force(spark, cell):
    draw = random.Random(5)
    rows = [(draw.choice(["hot"] * 4 + ["a", None]), draw.choice([None, *range(-90, 90, 3)]), i, draw.choice([None, *range(9)])) for i in range(120)]
    rows += [("far", -7, 900, 1), ("far", 30_000, 901, 5), ("single", 10, 902, 1), ("tied", 10, 903, 1), ("tied", 10, 904, 2)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "k string, t int, id int, v int, at int, key int").repartition(3)
    got = {(r.k, r.at): (r.carried, round(r.linear, 9)) for r in resampled(df, "k", F.col("t"), "id", "v", 5, cell).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        known = sorted((t, i, v) for key, t, i, v in rows if key == k and None not in (t, v))
        for t in range(known[0][0], known[-1][0]):
            if t % 5 == 0:
                before, after = [r for r in known if r[0] <= t][-1], [r for r in known if r[0] > t][0]
                want[k, t] = (before[2], round(before[2] + (after[2] - before[2]) * (t - before[0]) / (after[0] - before[0]), 9))
    assert got == want and len(want) > 6000 and {k for k, _ in want} == {"hot", "a", None, "far"}
    assert resampled(df.limit(0), "k", F.col("t"), "id", "v", 5, cell).count() == 0
