"""The rows before each row, without a task for a whole key, and regular times with values carried or drawn between rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def preceding(df: DataFrame, keys: list[str], at: Column, tie: Column, values: list[str], reach: int, cell: Column, number: str = "number", before: str = "before") -> DataFrame:
    """Adds each row's number within its keys, from 1, and an array of the `reach` rows before it (structs of `values`, oldest first).

    `cell` never falls as time rises, such as a day, and deals a key's rows to cells, so that no task gets a whole hot key. Rows shuffle once. Each cell gets a halo from a table of
    a row for each key and cell: how many rows came before, and the last `reach` of them, which lie in as many cells before it at most, as a cell there is has a row.

    Defined results: null keys are a key like any other; rows with a null time come first, in a cell of their own if `cell` is null for them; rows of one time go by
    `tie`, and those alike in it in no certain order; first rows have shorter arrays, or empty ones; an empty table gives no rows; columns named as results are
    replaced, others stay, whatever their names.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in (number, before)))
    dealt = F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)), cell.alias("cell"))
    kept = F.struct(*(F.col(f"`{v}`") for v in values))
    rows = df.select(row.alias("row"), dealt.alias("dealt"), at.alias("at"), tie.alias("tie"), kept.alias("kept"))
    inside = Window.partitionBy("dealt").orderBy("at", "tie")
    near = F.collect_list("kept").over(inside.rowsBetween(-reach, 0))  # with the row itself
    local = rows.select("row", "dealt", F.row_number().over(inside).cast("long").alias("place"), near.alias("near"))
    # counts combine, and rows beyond the last `reach` of a cell are dropped, before they shuffle
    counts = rows.groupBy("dealt").agg(F.count(F.lit(1)).alias("n"))
    back = F.row_number().over(Window.partitionBy("dealt").orderBy(F.desc_nulls_last("at"), F.desc_nulls_last("tie")))
    ends = rows.select("dealt", "kept", back.alias("back")).where(F.col("back") <= reach).groupBy("dealt").agg(F.collect_list(F.struct("back", "kept")).alias("ends"))
    tail = F.transform(F.array_sort("ends", lambda a, b: b["back"] - a["back"]), lambda r: r["kept"])
    tails = counts.join(ends.select("dealt", tail.alias("tail")), "dealt")
    cells = Window.partitionBy(*(F.col(f"dealt.k{i}") for i in range(len(keys)))).orderBy("dealt.cell")
    earlier = F.flatten(F.collect_list("tail").over(cells.rowsBetween(-reach, -1)))
    base = F.coalesce(F.sum("n").over(cells.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    halo = tails.select("dealt", base.alias("base"), earlier.alias("tails"))
    own = F.slice("near", 1, F.size("near") - 1)
    seen = F.concat("tails", own)
    found = local.join(halo, "dealt").select("row", (F.col("base") + F.col("place")).alias("number"), seen.alias("seen"))
    last = F.slice("seen", F.greatest(F.lit(1), F.size("seen") - reach + 1), reach)
    return found.select("row", "number", last.alias("seen")).select("row.*", F.col("number").alias(number), F.col("seen").alias(before))


def resampled(df: DataFrame, key: str, at: Column, tie: str, value: str, step: int, cell: int) -> DataFrame:
    """Values at regular times, the multiples of `step` from each key's first row to before its last: (key, at, carried, linear).

    `carried` is the value of the last row at or before the time; `linear` lies on the line from that row to the next. Each row makes the times since the row before it, so no grid is
    joined, and rows shuffle once, dealt to cells of `cell` (in the unit of `at`, whole numbers). Times of long gaps are made in blocks of 1,024, so that no row
    holds an array of all.

    Defined results: a null key is a key like any other; rows with a null time or value count for nothing; of rows of one time the one with the largest tie
    is carried, and a line ends at the smallest; keys with rows of one time only, and an empty table, give no rows.
    """
    rows = df.select(F.col(f"`{key}`").alias("key"), at.cast("long").alias("at"), F.col(f"`{tie}`").alias("tie"), F.col(f"`{value}`").cast("double").alias("value")).where("at IS NOT NULL AND value IS NOT NULL")
    with_last = preceding(rows, ["key"], F.col("at"), F.col("tie"), ["at", "value"], 1, F.floor(F.col("at") / cell))
    pairs = with_last.select("key", F.get("before", F.lit(0)).alias("last"), F.struct("at", "value").alias("next")).where("last.at < next.at")
    first, final = F.expr(f"last.at + pmod(-last.at, {step}L)"), F.expr(f"next.at - 1 - pmod(next.at - 1, {step}L)")
    spans = pairs.select("key", "last", "next", first.alias("first"), final.alias("final")).where("first <= final")
    blocks = spans.select("*", F.explode(F.sequence("first", "final", F.lit(step * BLOCK).cast("long"))).alias("begin"))
    times = blocks.select("*", F.explode(F.sequence("begin", F.least("final", F.col("begin") + step * (BLOCK - 1)), F.lit(step).cast("long"))).alias("t"))
    share = (F.col("t") - F.col("last.at")) / (F.col("next.at") - F.col("last.at"))
    linear = F.col("last.value") + (F.col("next.value") - F.col("last.value")) * share
    return times.select(F.col("key").alias(key), F.col("t").alias("at"), F.col("last.value").alias("carried"), linear.alias("linear"))
