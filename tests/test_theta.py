"""Counts by inequalities against all pairs."""

import math
import random

import pytest

from tidemill.operators.theta import theta_counts


def brute(left, right, dx, dy):
    usable = [(x, y) for _, x, y in right if None not in (x, y) and not math.isnan(x) and not math.isnan(y)]
    ok = lambda a, b, x, y: x < a and y > b and (dx is None or a - x <= dx) and (dy is None or y - b <= dy)
    return {i: 0 if None in (a, b) else sum(ok(a, b, x, y) for x, y in usable) for i, a, b in left}


@pytest.mark.parametrize("bounds", [(None, None), (7.0, None), (None, 5.0), (7.0, 5.0)])
@pytest.mark.parametrize("cells", [1, 16])
def test_equals_all_pairs(spark, bounds, cells):
    draw = random.Random(cells)
    value = lambda: draw.choice([None, float("nan"), 3.0, 3.0, 3.0, *map(float, range(30)), draw.random() * 30])
    left, right = ([(i, value(), value()) for i in range(n)] for n in (150, 260))
    right += [(0, 3.0, float(k % 20)) for k in range(200)] + [(0, float(k % 20), 9.0) for k in range(200)]
    left = [r for r in left if not any(isinstance(v, float) and math.isnan(v) for v in r[1:])] + [(999, 3.0, 3.0), (1000, None, 1.0)]
    frames = [spark.createDataFrame(rows, "id int, x double, y double").repartition(3) for rows in (left, right)]
    frames[0] = frames[0].selectExpr("*", "'a' AS n", "'b' AS `query`", "'c' AS `a.b`")
    out = theta_counts(*frames, "x", "y", *bounds, cells=cells)
    assert out.columns == ["id", "x", "y", "query", "a.b", "n"]
    assert {r.id: r.n for r in out.collect()} == brute(left, right, *bounds)


def test_plans_have_no_nested_loop_and_empty_sides_give_zeros(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0), (2, 5.0, 1.0), (2, 5.0, 1.0)], "id int, x double, y double")
    out = theta_counts(rows, rows, "x", "y", 10, 10)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2.0, 3.0, 0), (2, 5.0, 1.0, 1), (2, 5.0, 1.0, 1)]
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    none = rows.limit(0)
    assert [r.n for r in theta_counts(rows, none, "x", "y").collect()] == [0, 0, 0] and theta_counts(none, rows, "x", "y").count() == 0


@pytest.mark.parametrize("bounds", [(None, None), (7.0, None), (None, 5.0), (7.0, 5.0)])
def test_few_values_of_x_are_swept_once(spark, bounds):
    draw = random.Random(3)
    ends = [math.inf, -math.inf, 1.7976931348623157e308, -1.7976931348623157e308, -0.0, 0.0]
    value = lambda: draw.choice([None, *ends, *map(float, range(12)), *map(float, range(12))])
    left, right = ([(i, value(), draw.choice([value(), draw.random() * 12])) for i in range(n)] for n in (200, 300))
    left += [(500 + k, k + 0.5, 3.0) for k in range(12)]  # between the values of the right side
    frames = [spark.createDataFrame(rows, "id int, x double, y double").repartition(3) for rows in (left, right)]
    out = theta_counts(*frames, "x", "y", *bounds, cells=16)
    assert {r.id: r.n for r in out.collect()} == brute(left, right, *bounds)
    plan = theta_counts(*frames, "x", "y", *bounds, cells=16)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_earlier") == 1


@pytest.mark.parametrize("bounds", [(None, None), (0.2, None), (None, 0.1), (0.2, 0.1)])
def test_many_values_of_x_with_hot_ones_equal_all_pairs(spark, bounds):
    draw = random.Random(4)
    value = lambda: draw.choice([0.5, 0.25, 0.5 + 2**-53, draw.random(), draw.random(), draw.random(), draw.random()])
    left, right = ([(i, value(), value()) for i in range(n)] for n in (300, 900))
    frames = [spark.createDataFrame(rows, "id int, x double, y double").repartition(3) for rows in (left, right)]
    usable = {i: sum(x < a and y > b and (bounds[0] is None or x >= a - bounds[0]) and (bounds[1] is None or y <= b + bounds[1]) for _, x, y in right) for i, a, b in left}
    assert {r.id: r.n for r in theta_counts(*frames, "x", "y", *bounds, cells=8).collect()} == usable


def test_infinity_is_above_the_greatest_number(spark):
    most = 1.7976931348623157e308
    right = spark.createDataFrame([(0, 0.0, y) for y in (1.0, most, most, most, math.inf)], "id int, x double, y double")
    left = spark.createDataFrame([(1, 1.0, most), (2, 1.0, 1.0), (3, 1.0, math.inf)], "id int, x double, y double")
    assert {r.id: r.n for r in theta_counts(left, right, "x", "y", cells=2).collect()} == {1: 1, 2: 4, 3: 0}
