"""As-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _packed(df: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], tie: str, cell: Column | None = None) -> DataFrame:
    """Adds to each left row the values of the last right row of its keys at or before its time, as asof_ columns.

    Both sides are stacked and shuffled once by the keys; a running last value replaces a join, so rows
    never multiply. `cell` (an expression over both sides that never falls as time rises, such as a day) deals the rows of a key
    to its cells, so that no task gets a whole hot key: running values stay within cells, and each cell
    starts from the last value of the cells before, from a table of a row for each key and cell.

    Defined results: `tie` is a column of both sides; of right rows at the same time the one with
    the largest tie counts. Left rows without one get nulls, as do those with a null key or time; right rows with
    a null time count for nothing. An empty side gives nulls or no rows. Left columns keep their names, whatever they are.
    """
    by = [f"k{i}" for i in range(len(keys))]

    def side(df: DataFrame, number: int, row: Column, value: Column) -> DataFrame:
        own = [F.col(f"`{k}`").alias(b) for k, b in zip(keys, by, strict=True)]
        dealt = F.struct(*own, (F.lit(0) if cell is None else cell).alias("cell"))
        return df.select(row.alias("row"), dealt.alias("dealt"), F.col(f"`{at}`").alias("at"), F.col(f"`{tie}`").alias("tie"), F.lit(number).alias("side"), value.alias("value"))

    known = right.where(F.col(f"`{at}`").isNotNull())
    value = F.struct(*(F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)))
    value_kind = known.select(value.alias("v")).schema["v"].dataType
    a = side(left, 1, _packed(left), F.lit(None).cast(value_kind))
    b = side(known, 0, F.lit(None).cast(left.select(_packed(left).alias("r")).schema["r"].dataType), value)
    order = Window.partitionBy("dealt").orderBy("at", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    stacked = a.unionByName(b).withColumn("found", F.last("value", ignorenulls=True).over(order))
    found = stacked.where("side = 1")
    if cell is not None:
        # a group is as the window dealt it, so rows shuffle once
        ends = stacked.groupBy("dealt").agg(F.max(F.when(F.col("side") == 0, F.struct("at", "tie", "value"))).alias("last"))
        earlier = Window.partitionBy(*(F.col(f"dealt.{k}") for k in by)).orderBy("dealt.cell").rowsBetween(Window.unboundedPreceding, -1)
        found = found.join(ends.select("dealt", F.last("last", ignorenulls=True).over(earlier)["value"].alias("before")), "dealt", "left").withColumn("found", F.coalesce("found", "before"))
    present = F.col("at").isNotNull()
    for k in by:
        present &= F.col(f"dealt.{k}").isNotNull()
    return found.select("row", F.when(present, F.col("found")).alias("found")).select("row.*", *(F.col("found")[f"v{i}"].alias(f"asof_{v}") for i, v in enumerate(values)))


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, stop: str, width: int) -> DataFrame:
    """Pairs of points and spans with equal keys and start <= at < stop, all as long numbers.

    Spans are dealt to the cells they touch, of `width` times a power of 16 that is the first to hold the span's length, and points to
    their cell of each size that spans have. So a span touches two cells at most, however long it is (open ends may be stated by the least and the largest
    long number), and the join is an equality on keys, size and cell that shuffles evenly.

    Defined results: rows with a null key or bound pair with nothing, as do spans that end by their start; equal rows each give
    their pairs; an empty side gives no pairs. Columns are the points' and then the spans' without keys; names that both have stay ambiguous,
    as in any join.
    """
    most = 16  # a cell of 2^64 holds any span
    length = F.try_subtract(F.col(f"`{stop}`").cast("long"), F.col(f"`{start}`").cast("long"))
    steps = F.ceil(F.log(F.greatest(length / width, F.lit(1.0))) / F.log(F.lit(16.0)) - 1e-9).cast("int")
    size = F.when(length.isNull(), most).otherwise(F.least(F.lit(most), F.greatest(F.lit(0), steps)))
    scale = F.lit(float(width)) * F.pow(F.lit(16.0), F.col("size"))
    held = spans.where(F.col(f"`{start}`") < F.col(f"`{stop}`")).select(_packed(spans).alias("span"), *(F.col(f"`{k}`").alias(f"b{i}") for i, k in enumerate(keys)), F.col(f"`{start}`").alias("start"), F.col(f"`{stop}`").alias("stop"), size.alias("size"))
    dealt = held.withColumn("cell", F.explode(F.array_distinct(F.array(F.floor(F.col("start") / scale), F.floor((F.col("stop") - 1) / scale)))))
    sizes = F.broadcast(held.select("size").distinct())  # 17 rows at most
    placed = points.select(_packed(points).alias("point"), *(F.col(f"`{k}`").alias(f"a{i}") for i, k in enumerate(keys)), F.col(f"`{at}`").alias("at"))
    placed = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(most))).alias("size")).join(sizes, "size").withColumn("cell", F.floor(F.col("at") / scale)).withColumnsRenamed({"size": "asize", "cell": "acell"})
    same = (F.col("asize") == F.col("size")) & (F.col("acell") == F.col("cell"))
    for i in range(len(keys)):
        same &= F.col(f"a{i}") == F.col(f"b{i}")
    met = placed.join(dealt, same).where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop")))
    return met.select("point.*", *(F.col(f"span.`{c}`") for c in spans.columns if c not in keys))


def epoch(column: str) -> Column:
    """Whole seconds of a timestamp without zone, read as UTC."""
    return F.unix_timestamp(F.col(column).cast("timestamp"))
