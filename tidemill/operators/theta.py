"""Joins by inequalities alone, counted: for each row of one side, how many rows of the other are below it in x and above it in y.

Both columns are cut at quantiles of the right side into `cells` ranges each; a value that fills a range of its own, as a hot one does, gets it. Where x has few
distinct values, as days, it is cut at each of them. A row of cells is swept from behind in y, with a count for each column of cells that starts with what lies
behind the row: a left row takes the whole columns before its own, or those between its own and its bound's. If x is cut at quantiles, what is left is in the column
that it lies in: its rows of cells behind in y by a second sweep, and its own cell by a third one. Rows are sorted by Spark, group by group, and read in one
pass that holds a count for each range, or for each value of one cell. So no pair of rows is formed, no nested loop runs, and rows shuffle once where x has few values, and three
times otherwise, whatever they match. Rows of the right side whose range is a single value can't be strictly below or above another one there, and stay out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.session import Scratch

#: Events that are compared with one another at once.
AT_ONCE = 512


def cuts(df: DataFrame, column: str, cells: int) -> tuple[list[float], list[bool]]:
    """Where ranges of a column start, but for the first: `cells` quantiles, and the next number behind those that are met twice; and which ranges are one value."""
    found = df.select(F.percentile_approx(column, [i / cells for i in range(cells)], 50 * cells)).first()[0] or []
    starts = set(found)
    for a, b in zip(found, found[1:], strict=False):
        if a == b and a < np.finfo(float).max:
            starts.add(float(np.nextafter(a, np.inf)))
    edges = sorted(starts)
    # the last range holds infinity, so that it is one value only if it starts there
    return edges, [*(bool(np.nextafter(a, np.inf) == b) for a, b in zip([-np.inf, *edges], edges, strict=False)), bool(edges) and edges[-1] == np.inf]


def cuts_at_values(df: DataFrame, column: str, most: int) -> tuple[list[float], list[bool]] | None:
    """Ranges that each end with a value of a column of at most `most` distinct ones: what is in a range is never below anything else in it."""
    if df.select(F.approx_count_distinct(column)).first()[0] > 1.3 * most:
        return None
    found = sorted(r[0] for r in df.select(column).distinct().limit(most + 1).collect())
    return ([float(np.nextafter(v, np.inf)) for v in found], [True] * (len(found) + 1)) if len(found) <= most else None


def _placed(df: DataFrame, places: dict[str, tuple[str, tuple[list[float], list[bool]]]]) -> DataFrame:
    """Adds, for each cell name, the number of the range that holds a column's value, and whether that range is one value. A null is in the last range."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {cell: (column, np.array(edges), np.array(alone)) for cell, (column, (edges, alone)) in places.items()}
        for batch in batches:
            columns, names = list(batch.columns), list(batch.schema.names)
            for cell, (column, edges, alone) in known.items():
                at = np.searchsorted(edges, batch.column(column).to_numpy(zero_copy_only=False).astype(np.float64), "right")
                columns += [pa.array(at, pa.int32()), pa.array(alone[at])]
                names += [cell, f"{cell}_alone"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = [f"{n} {k}" for n, k in df.dtypes] + [f"{cell} int, {cell}_alone boolean" for cell in places]
    return df.mapInArrow(placed, ", ".join(kinds))


def _earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each query, the weight of data rows before it in its group whose `low` is in its range from `low` to under `high`, times its own. Batches: group, low, high, weight, id (null: data) sorted by group."""
    group, counts = None, np.zeros(16, np.int64)
    for batch in batches:
        groups, lows, highs, weights, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("group", "low", "high", "weight", "id"))
        is_query, out = batch.column("id").is_valid().to_numpy(zero_copy_only=False), []
        edges = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
        for start, end in zip(edges, edges[1:], strict=False):
            if start == end:
                continue
            if groups[start] != group:
                group, counts = groups[start], np.zeros(16, np.int64)
            for a in range(start, end, AT_ONCE):
                b = min(end, a + AT_ONCE)
                asks = is_query[a:b]
                mine, data = np.flatnonzero(asks), np.flatnonzero(~asks)
                low, high, now, weight = lows[a:b][mine], highs[a:b][mine], lows[a:b][data], weights[a:b][data]
                most = int(max(high.max(initial=0), now.max(initial=-1) + 1))
                if most > len(counts):
                    counts = np.concatenate([counts, np.zeros(max(len(counts), most - len(counts)), np.int64)])
                if len(mine):
                    upto = np.concatenate([[0], np.cumsum(counts)])
                    found = upto[high] - upto[low]
                    if len(data):
                        inside = (data[None, :] < mine[:, None]) & (now[None, :] >= low[:, None]) & (now[None, :] < high[:, None])
                        found = found + (inside.astype(np.float64) @ weight.astype(np.float64)).astype(np.int64)  # exact up to 2^53
                    out.append((ids[a:b][mine].astype(np.int64), found * weights[a:b][mine]))
                np.add.at(counts, now, weight)
        found_ids, n = (np.concatenate([o[k] for o in out]) if out else np.empty(0, np.int64) for k in (0, 1))
        held = n != 0
        yield pa.RecordBatch.from_arrays([pa.array(found_ids[held]), pa.array(n[held])], ["id", "n"])


def _row(group: Column, order: Column, low: Column, high: Column, weight: Column, id: Column) -> list[Column]:
    """Columns of a row to sweep. order: null comes first; weight of a query: its sign; id: null for data."""
    kinds = {"group": "long", "order": "double", "low": "int", "high": "int", "weight": "long", "id": "long"}
    return [c.cast(k).alias(n) for (n, k), c in zip(kinds.items(), (group, order, low, high, weight, id), strict=True)]


def _swept(parts: list[DataFrame]) -> DataFrame:
    """id and n of queries: what data rows of their groups with a strictly smaller order weigh."""
    # of equal order queries come first, as the comparison is strict
    dealt = reduce(DataFrame.union, parts).repartition("group").sortWithinPartitions("group", "order", F.col("id").isNull())
    return dealt.select("group", "low", "high", "weight", "id").mapInArrow(_earlier, "id long, n long")


def box_counts(spark: SparkSession, points: DataFrame, asks: DataFrame, cells: int = 256) -> DataFrame:
    """id and n, summed by id: for each ask how many points have x from x_low to under x and y from above y to y_high. points: x, y; asks: id (unique long), x, y, x_low, y_high (null: no bound); all doubles.

    Points and asks with a null or NaN x or y match nothing, and asks that match nothing may have no row.
    """
    scratch = Scratch(spark, "theta")
    whole = lambda df: df.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    points = whole(points.select("x", "y"))
    xs, ys = cuts_at_values(points, "x", 16 * cells) or cuts(points, "x", cells), cuts(points, "y", cells)
    data = scratch.save(_placed(points, {"i": ("x", xs), "j": ("y", ys)}))
    asks = scratch.save(_placed(whole(asks), {"i": ("x", xs), "i_low": ("x_low", xs), "j": ("y", ys), "j_high": ("y_high", ys)}))
    one, none, no_id = F.lit(1), F.lit(0), F.lit(None)
    # what lies behind a row of cells in y, by columns of cells, comes before all that lies in the row
    wide = len(ys[0]) + 1
    filled = data.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range((len(xs[0]) + 1) * wide).selectExpr(f"cast(id div {wide} as int) AS i", f"cast(id % {wide} as int) AS j").join(filled, ["i", "j"], "left").fillna(0, ["n"])
    behind = F.sum("n").over(Window.partitionBy("i").orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, -1))
    seeds = grid.select("i", "j", behind.alias("n")).where("n > 0")
    rows = [
        seeds.select(*_row(F.col("j"), F.lit(None), F.col("i"), none, F.col("n"), no_id)),
        data.where("NOT j_alone").select(*_row(F.col("j"), -F.col("y"), F.col("i"), none, one, no_id)),
    ]
    # whole columns of cells: from the lower bound's on to those before x, above y less those above its bound
    first = F.when(F.col("x_low").isNotNull(), F.least("i_low", "i")).otherwise(0)
    for y, j, sign in (("y", "j", 1), ("y_high", "j_high", -1)):
        rows.append(asks.where(F.col(y).isNotNull()).select(*_row(F.col(j), -F.col(y), first, F.col("i"), F.lit(sign), F.col("id"))))
    parts = [_swept(rows)]
    if not all(xs[1]):
        # the rest of the columns that x and its bound lie in: rows of cells behind that of y whole
        last = F.when(F.col("y_high").isNotNull(), F.col("j_high") + 1).otherwise(wide)
        columns = [data.where("NOT i_alone").select(*_row(F.col("i"), F.col("x"), F.col("j"), none, one, no_id))]
        corners = []
        for x, i, sign in (("x", "i", 1), ("x_low", "i_low", -1)):
            some = asks.where(F.col(x).isNotNull() & ~F.col(f"{i}_alone"))
            columns.append(some.select(*_row(F.col(i), F.col(x), F.col("j") + 1, F.greatest(last, F.col("j") + 1), F.lit(sign), F.col("id"))))
            for y, j, side in (("y", "j", 1), ("y_high", "j_high", -1)):
                corner = some.where(F.col(y).isNotNull() & ~F.col(f"{j}_alone"))
                corners.append(corner.select("id", F.col(x).alias("x"), F.col(y).alias("y"), F.col(i).alias("i"), F.col(j).alias("j"), F.lit(sign * side).alias("weight")))
        parts.append(_swept(columns))
        # within one cell the values of x are numbered
        inner, asked = data.where("NOT i_alone AND NOT j_alone").select(F.lit(None).cast("long").alias("id"), "x", "y", "i", "j", F.lit(1).alias("weight")), reduce(DataFrame.union, corners)
        held = asked.select("i", "j").distinct().join(inner.select("i", "j").distinct(), ["i", "j"])
        numbered = inner.unionByName(asked).join(held, ["i", "j"]).withColumn("rank", F.dense_rank().over(Window.partitionBy("i", "j").orderBy("x")))
        at = F.col("id").isNull()
        group = F.col("i").cast("long") * wide + F.col("j")
        parts.append(_swept([numbered.select(*_row(group, -F.col("y"), F.when(at, F.col("rank")).otherwise(0), F.col("rank"), F.col("weight"), F.col("id")))]))
    return reduce(DataFrame.union, parts).groupBy("id").agg(F.sum("n").alias("n"))


def theta_counts(left: DataFrame, right: DataFrame, x: str, y: str, within_x: float | None = None, within_y: float | None = None, name: str = "n", cells: int = 256) -> DataFrame:
    """Left columns, and how many right rows have a smaller x, by at most within_x, and a greater y, by at most within_y.

    A bound of y is asked for by a row of its own with the other sign, one of x by the range of columns that a row takes.

    Defined results: rows with a null or NaN x or y match nothing and count 0; equal values aren't smaller or greater; numbers are compared as
    doubles; repeated rows count each; an empty side gives zeros or no rows; a column named as the result is replaced, others
    stay, whatever their names.
    """
    spark = left.sparkSession
    scratch = Scratch(spark, "theta")
    kept = [c for c in left.columns if c != name]
    rows = left.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y"))
    rows = scratch.save(rows.select("*", F.monotonically_increasing_id().alias("id")))  # numbers may change when rows are read again
    bound = lambda c: F.when(~F.isnan(c), c)
    x_low = F.lit(None).cast("double") if within_x is None else bound(F.col("x") - F.lit(float(within_x)))
    y_high = F.lit(None).cast("double") if within_y is None else bound(F.col("y") + F.lit(float(within_y)))
    asks = rows.select("id", "x", "y", x_low.alias("x_low"), y_high.alias("y_high"))
    points = right.select(F.col(f"`{x}`").cast("double").alias("x"), F.col(f"`{y}`").cast("double").alias("y"))
    return rows.join(box_counts(spark, points, asks, cells), "id", "left").select("row.*", F.coalesce("n", F.lit(0)).alias(name))
