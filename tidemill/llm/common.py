"""What several operators share: text batches, connected components, and the rows of components that stay."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import Scratch

#: White space of the contracts: space, and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
#: Characters of the longest texts that caches of tokens keep, so that a bound on their number bounds their bytes.
LONGEST_KEPT = 64


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice hold about `most` bytes, or are a single row."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """Connected components of a graph by alternating large-star and small-star rounds.

    edges: columns a and b, longs; loops, repeats, both directions and nulls are allowed.
    Returns node and component (smallest node reachable), for nodes on some edge that isn't
    a loop. Each round is two joins on node ids, so no adjacency list is gathered anywhere;
    rounds grow with the logarithm of the longest component. Smallest neighbours are tables of their own, so
    that a join can split the rows of a node with very many links. Each round's tables replace
    those before in the shared folder.
    """
    a, b = F.col("a"), F.col("b")
    now = scratch.save(
        edges.where((a != b) & a.isNotNull() & b.isNotNull())
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    mark = _mark(now)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.save(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = scratch.save(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        for old in (now, low, large, least):
            scratch.drop(old)
        now, was = after, mark
        mark = _mark(now)
        if mark == was:
            break
    else:
        raise RuntimeError("components didn't settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def keep_one(docs: DataFrame, rows: DataFrame, id_col: str, raw: Column, scratch: Scratch) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component that with the smallest id, nulls last.

    rows: _id, _raw (the value of `raw`, which tells apart rows that share an id) and component. Rows that are alike in
    both share a decision.
    """
    rank = F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_raw").alias("r"))
    best = scratch.save(rows.groupBy("component").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    lost = rows.join(best, "component").where(~(F.col("_id").eqNullSafe(F.col("best.i")) & F.col("_raw").eqNullSafe(F.col("best.r"))))
    # a table, so that Spark knows its size and broadcasts it if it is small: then no text shuffles
    gone = scratch.save(lost.select(F.col("_id").alias("_gone"), F.col("_raw").alias("_gone_raw")).distinct())
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{id_col}`").alias("_id"), raw.alias("_raw"))
    same = F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_raw") == F.col("_gone_raw"))
    return packed.join(gone, same, "left_anti").select("_row.*")


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row.n, row.x or 0
