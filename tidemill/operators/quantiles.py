"""Exact quantiles of groups and ranks over all rows, without a task that gets a whole group.

A quantile is a rank of a group's sorted values. Each round counts the values of each range between `cuts` estimated quantiles of those that are left, with map-side
combining: a fixed number of counts for each target. The range that holds the rank is what is left for the next round, until it is one value,
or has so few that they are sorted. Estimates only say where to cut; counts decide, so the result is exact whatever they are.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import Scratch


def _least(p: float) -> Column:
    """The rank (from 0) of the least value that a share `p` of the `n` values don't exceed, in decimals, as 0.9 of 10 values are 9 and not a bit more."""
    return F.greatest(F.ceil(F.col("n").cast("decimal(19, 0)") * F.lit(Decimal(repr(float(p))).quantize(Decimal(1).scaleb(-15)))) - 1, F.lit(0)).cast("long")


def _targets(sizes: DataFrame, probabilities: list[float], discrete: bool) -> DataFrame:
    """The two ranks (from 0) between which each quantile lies, or the one that it is."""
    if discrete:
        return sizes.select("g", F.explode(F.array_distinct(F.array(*map(_least, probabilities)))).alias("rank"))
    lower = F.floor(F.col("n") - 1).cast("double")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(float(p)) * lower).alias("place")) for k, p in enumerate(probabilities)))).alias("p")
    rows = sizes.select("g", each).select("g", "p.k", F.explode(F.array_distinct(F.array(F.floor("p.place"), F.ceil("p.place")))).alias("rank"))
    return rows.select("g", "rank").distinct()


def ranked_values(rows: DataFrame, targets: DataFrame, scratch: Scratch, cuts: int = 64, few: int = 4096, most_rounds: int = 60, first: DataFrame | None = None) -> DataFrame:
    """g, rank and v: the value of each rank (from 0) among the rows (g, v) of its group. No nulls among v. first: g and edges to cut at in the first round; a group without is cut at its ends."""
    wide = rows.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
    left = scratch.save(targets.join(wide, "g").select("g", "rank", "low", "high", F.lit(0).cast("long").alias("before"), "n"))
    inside = F.col("v").between(F.col("low"), F.col("high"))
    for k in range(most_rounds):
        big = left.where(F.col("low") != F.col("high")).where(F.col("n") > few)
        if big.isEmpty():
            break
        held = rows.join(big, "g").where(inside)
        if first is not None and k == 0:
            edges = big.join(first, "g", "left").select("g", "rank", F.coalesce("edges", F.array("low", "high")).alias("edges"))
        else:
            edges = held.groupBy("g", "rank").agg(F.percentile_approx("v", [i / cuts for i in range(cuts + 1)], 20 * cuts).alias("edges"))
        edges = scratch.save(edges.select("g", "rank", F.array_distinct("edges").alias("edges")))
        # two ranges for each edge: the values between it and the edge before, and those equal to it, so that a hot value is alone
        above = F.size(F.filter("edges", lambda e: e < F.col("v")))
        equal = F.array_contains("edges", F.col("v")).cast("int")
        binned = held.join(edges, ["g", "rank"]).groupBy("g", "rank", (2 * above + equal).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.first("before").alias("base"))
        upto = F.sum("n").over(Window.partitionBy("g", "rank").orderBy("bin"))
        found = binned.withColumn("before", F.col("base") + upto - F.col("n")).where("before <= rank AND rank < before + n")
        done = left.where(~((F.col("low") != F.col("high")) & (F.col("n") > few)))
        left = scratch.save(done.unionByName(found.select("g", "rank", "low", "high", "before", "n")))
    else:
        raise RuntimeError("quantiles didn't settle")
    one = left.where("low = high").select("g", "rank", F.col("low").alias("v"))
    some = rows.join(left.where("low != high"), "g").where(inside)
    number = F.row_number().over(Window.partitionBy("g", "rank").orderBy("v")) - 1  # of `few` values at most
    return one.union(some.withColumn("number", number).where("number = rank - before").select("g", "rank", "v"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], cuts: int = 64, few: int = 4096, discrete: bool = False, first: DataFrame | None = None) -> DataFrame:
    """Keys, n (values that aren't null) and q0, q1, ...: interpolated quantiles, as DuckDB's quantile_cont or Spark's percentile, or discrete ones, as quantile_disc.

    first: keys and edges, an array of estimates for each group, as of a sketch (`sketches.edges`), which spare the pass that estimates where to cut. Wrong ones cost rounds and change no result.

    Defined results: null and NaN values don't count, and groups without others have no row; a null key is a key like any other; ties and repeated rows
    count each; values are doubles; an empty table gives no rows; other columns stay out.
    """
    if not probabilities or not all(0 <= p <= 1 for p in probabilities):
        raise ValueError("probabilities lie between 0 and 1")
    scratch = Scratch(df.sparkSession, "quantiles")
    group = F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys))) if keys else F.struct(F.lit(0).alias("k"))
    rows = scratch.save(df.select(group.alias("g"), F.col(f"`{value}`").cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)"))
    sizes = scratch.save(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    if first is not None:
        first = scratch.save(first.select(group.alias("g"), F.col("edges").cast("array<double>").alias("edges")).where("edges IS NOT NULL"))
    values = ranked_values(rows, _targets(sizes, probabilities, discrete), scratch, cuts, few, first=first)
    held = sizes.join(values.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at")), "g")  # two for each quantile

    def quantile(p: float) -> Column:
        if discrete:
            return F.element_at("at", _least(p))
        place = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.element_at("at", F.floor(place)), F.element_at("at", F.ceil(place))
        return low + (high - low) * (place - F.floor(place))

    return held.select(*(F.col(f"g.k{i}").alias(k) for i, k in enumerate(keys)), "n", *(quantile(p).alias(f"q{i}") for i, p in enumerate(probabilities)))


def global_ranks(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """All columns, and the rank of each row's value over the whole table, 1 for the least; equal values share a rank.

    Values are counted first, with map-side combining, so a hot value is one row; ranges of distinct values are numbered each in its task, with what ranges
    before hold from a table of a row for each range. No window without keys gets the table.

    Defined results: null values have a null rank and count for nobody; NaN is the largest; an empty table gives no rows; a column named as the
    result is replaced, others stay, whatever their names.
    """
    scratch = Scratch(df.sparkSession, "ranks")
    counts = df.groupBy(F.col(f"`{value}`").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("v IS NOT NULL")
    ranges = scratch.save(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sizes = ranges.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("part", before.alias("base"))  # a row for each range, some hundreds
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = scratch.save(ranges.withColumn("inside", inside).join(F.broadcast(base), "part").select("v", (F.col("base") + F.col("inside") + 1).alias("r")))
    kept = [c for c in df.columns if c != name]
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{value}`").alias("own"))
    return rows.join(ranked, F.col("own") == F.col("v"), "left").select("row.*", F.col("r").alias(name))
