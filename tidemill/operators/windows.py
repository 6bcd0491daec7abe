"""Top rows of groups and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark drops rows beyond k before it shuffles.

    Defined results: rows with null keys are groups like any other; nulls sort as `order` states; ties are kept apart by what `order` has
    last, else in no certain order; an empty table gives no rows; a column named as `rank` is replaced.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def sessions(df: DataFrame, key: str, at: Column, tie: str, gap_seconds: int, name: str = "session", cell_seconds: int = 86400) -> DataFrame:
    """Numbers each key's sessions from 1: a row starts one if it comes over gap_seconds after the row before.

    Rows of a key are dealt to cells of time, so that no task gets a whole hot key. They shuffle twice, once with no more than key, time and tie, for a table of a row for
    each key and cell: how many sessions started before the cell, and whether its first row starts one.

    Defined results: a null key is a key like any other; rows with a null time come first and are a session of their own; ties in time are of one
    session; an empty table gives no rows; a column named as the result is replaced, others stay, whatever their names.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != name))
    dealt = F.struct(F.col(f"`{key}`").alias("key"), F.floor(at / cell_seconds).alias("cell"))
    rows = df.select(row.alias("row"), dealt.alias("dealt"), at.alias("at"), F.col(f"`{tie}`").alias("tie"))
    inside, cells = Window.partitionBy("dealt").orderBy("at", "tie"), Window.partitionBy("dealt.key").orderBy("dealt.cell")
    late = F.coalesce(F.col("at") - F.lag("at").over(inside) > gap_seconds, F.lit(False)).cast("long")
    fresh = rows.withColumn("late", late)
    local = fresh.withColumn("upto", F.sum("late").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # a group is as the window dealt it
    ends = local.groupBy("dealt").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.sum("late").alias("n"))
    begins = F.coalesce(F.col("first") - F.lag("last").over(cells) > gap_seconds, F.lit(True)).cast("long")
    begun = ends.select("dealt", "n", begins.alias("begins"))
    base = F.sum(F.col("begins") + F.col("n")).over(cells.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    met = local.join(begun.select("dealt", base.alias("base")), "dealt")
    return met.select("row", (F.col("base") + F.col("upto")).alias("number")).select("row.*", F.col("number").alias(name))
