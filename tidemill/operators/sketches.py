"""Sketches kept in tables: a row for each key holds sketches of distinct values and of quantiles, which merge for any set of keys.

Rows are read once. Merged, two sketches are the sketch of both their rows, so that spans of days, or later days, take no more than the rows of the table. Distinct counts
are HLL sketches of 2^`bits` registers: their error is 1.04 over the root of those, 0.8 % for 14 bits, and none to speak of while a sketch still lists its
values. Quantiles are KLL sketches: the rank of an estimate is off by 2.3 / `k`^0.92 or less, 0.2 % for k of 2,000, with 99 % confidence, and exact for
no more than k values. Where exact quantiles are asked for, a sketch says where to look for them (`edges`), and rows are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS, K = 14, 2000


def sketched(df: DataFrame, keys: dict[str, Column], distinct: Column, values: Column, bits: int = BITS, k: int = K) -> DataFrame:
    """Keys, n (rows), users (a sketch of `distinct`) and spread (a sketch of `values`). Nulls count in neither sketch."""
    return df.groupBy(*(c.alias(n) for n, c in keys.items())).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, F.lit(bits)).alias("users"), F.kll_sketch_agg_double(values.cast("double"), F.lit(k)).alias("spread"))


def save(sketches: DataFrame, path: str) -> None:
    """Keep sketches as binary columns; rows of a key may come in several batches, as they merge when they are read."""
    sketches.write.mode("append").parquet(path)


def merged(spark: SparkSession, path: str, keys: dict[str, Column], probabilities: list[float], where: str = "true") -> DataFrame:
    """Keys, n, users (an estimate of the distinct values) and q0, q1, ... of what `where` selects of a table of sketches.

    Defined results: keys may be null, as any group's; a group whose values are all null has null quantiles and 0 users; nothing selected gives no rows.
    """
    some = spark.read.parquet(path).where(where).groupBy(*(c.alias(n) for n, c in keys.items()))
    both = some.agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), F.kll_merge_agg_double("spread").alias("spread"))
    has = F.kll_sketch_get_n_double("spread") > 0
    quantiles = [F.when(has, F.kll_sketch_get_quantile_double("spread", F.lit(float(p)))).alias(f"q{i}") for i, p in enumerate(probabilities)]
    return both.select(*keys, "n", "users", *quantiles)


def edges(spread: Column, probabilities: list[float], k: int = K) -> Column:
    """Values around the quantiles that a sketch estimates, apart by its error, for `exact_quantiles` to cut at; null where the sketch has no values."""
    off = 2.3 / k**0.92
    ranks = sorted({min(1.0, max(0.0, p + off * d)) for p in probabilities for d in (-1.5, -0.3, 0.0, 0.3, 1.5)})
    return F.when(F.kll_sketch_get_n_double(spread) > 0, F.kll_sketch_get_quantile_double(spread, F.array(*map(F.lit, ranks))))
