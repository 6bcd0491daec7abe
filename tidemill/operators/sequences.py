"""Rows matched one to one along a sequence, each used once: work that goes from row to row, which no window or join says."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemill.operators.windows import sessions


class _Queue:
    """Of one stretch of a key's rows in order: each row that takes gets the oldest free row of the last `within`. Holds free rows of that time only."""

    def __init__(self) -> None:
        self.free: deque[tuple[int, int]] = deque()

    def eval(self, row: Row):
        while self.free and self.free[0][0] < row["at"] - row["within"]:
            self.free.popleft()
        if row["gives"]:
            self.free.append((row["at"], row["id"]))
        elif self.free:
            yield self.free.popleft()[1], row["id"]


def matched_once(df: DataFrame, key: str, at: Column, id_col: str, gives: Column, takes: Column, within: int, cell: int) -> DataFrame:
    """Pairs (giver, taker) of ids: in order of time each row that takes is given the key's oldest row that gives, came before it by at most `within`, and has no taker yet.

    Nothing is matched over a pause of more than `within`, so a key's rows are cut there to stretches, which are tasks of their own; `cell` (in the unit of `at`, whole numbers) is what
    `sessions` deals rows by to find the pauses. A table function takes a stretch's rows in order, one at a time, and holds no more than the free givers of the last `within`.

    Defined results: rows with a null key, time or id match nothing; rows of one time go by id; a row that both gives and takes gives; null conditions are false;
    repeated ids are rows of their own; an empty table gives no pairs.
    """
    gives, takes = F.coalesce(gives, F.lit(False)), F.coalesce(takes, F.lit(False))
    rows = df.select(F.col(f"`{key}`").alias("key"), at.cast("long").alias("at"), F.col(f"`{id_col}`").cast("long").alias("id"), gives.alias("gives"), takes.alias("takes"))
    rows = rows.where("key IS NOT NULL AND at IS NOT NULL AND id IS NOT NULL AND (gives OR takes)").drop("takes")
    stretches = sessions(rows, "key", F.col("at"), "id", within, "stretch", cell).withColumn("within", F.lit(within).cast("long"))
    match = F.udtf(_Queue, returnType="giver long, taker long")
    return match(stretches.asTable().partitionBy("key", "stretch").orderBy("at", "id"))
