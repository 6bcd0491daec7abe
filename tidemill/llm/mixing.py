"""Mixing sources to target weights by hierarchical budgets, with DataFrame functions only.

A tree of domain, language and source has a weight at each node. The token budget is handed
down from the root: at each node, children share its budget in proportion to their weights, up
to what they hold over `epochs` passes; what a child can't use goes to its siblings by
their weights, and only what all of them can't use is lacking at the node itself, whose own
siblings got it already, since what a node holds is known before budgets go down. Each leaf takes whole passes while they fit
and then a prefix, by tokens, of one more pass, whose order is seeded by the pass and the id.

The tree's tables have a row for each node. Leaves' prefixes are found without sorting leaves:
tokens are summed by leaf and ranges of the order's hash, with map-side combining; running sums
over a leaf's 256 ranges tell the one the prefix ends in, and once more within that one; only the
rows of a 65,536th of a leaf are sorted. Rows then compare their hash with their leaf's cut, so texts don't shuffle unless the table of
leaves is too large for Spark to broadcast.

Defined results: null texts and texts without words have no tokens; a null domain, language or
source is a node named by the empty string; nodes without a stated weight get `default`; nodes of
weight zero get nothing; a null id orders as the empty string; rows that share an id, or have none, go by a hash of their text, and those alike in
both are taken together or not at all; an empty table gives an empty result; `mix` keeps all columns, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.session import Scratch

#: Hexadecimal digits of the order's hash that make a range: 256 ranges of a leaf, then 256 of the one its prefix ends in.
DIGITS = (2, 4)
LEAF = ("domain", "language", "source")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


@dataclass(frozen=True)
class Plan:
    """Weights by node name at each level, whole numbers; the share of all tokens to take; passes at most; seed."""

    domains: dict[str, int] = field(default_factory=dict)
    languages: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    default: int = 1
    share: float = 0.5
    epochs: int = 3
    seed: int = 11

    def weight(self, level: str) -> Column:
        stated = {"domain": self.domains, "language": self.languages, "source": self.sources}[level]
        out = F.lit(self.default)
        for name, weight in stated.items():
            out = F.when(F.col(level) == name, weight).otherwise(out)
        return out.cast("double")


def share_out(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Budgets of siblings: columns w (weight), cap (tokens they can use) and b (the parent's budget) become b (own).

    Sorted by tokens for each unit of weight, the children that can't use their share come first.
    """
    some = children.where("w > 0")
    order = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("w"), name)
    earlier = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = some.withColumn("full", F.col("cap").cast("double") * weight <= (F.col("b") - earlier).cast("double") * F.col("w"))
    group = Window.partitionBy(*parents)
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(group)
    part = F.floor(F.col("w") * (F.col("b") - used).cast("double") / open_weight)
    return full.withColumn("b", F.when(F.col("full"), F.col("cap")).otherwise(F.greatest(part, F.lit(0))).cast("long")).drop("full")


def leaf_budgets(leaves: DataFrame, plan: Plan, total: int) -> DataFrame:
    """Leaves with their tokens and budgets. leaves: LEAF columns and tokens."""
    caps = leaves.withColumn("cap", F.col("tokens") * plan.epochs)
    nodes = caps.groupBy("domain", "language").agg(F.sum("cap").alias("cap"))
    tops = nodes.groupBy("domain").agg(F.sum("cap").alias("cap"))
    budget = F.lit(int(total * plan.share)).cast("long")
    tops = share_out(tops.select("domain", "cap", budget.alias("b"), plan.weight("domain").alias("w")), [], "domain").select("domain", "b")
    nodes = share_out(nodes.join(tops, "domain").withColumn("w", plan.weight("language")), ["domain"], "language").select("domain", "language", "b")
    return share_out(caps.join(nodes, ["domain", "language"]).withColumn("w", plan.weight("source")), ["domain", "language"], "source").select(*LEAF, "tokens", "b")


def _key(id_column: Column, epoch: Column, seed: int) -> Column:
    """The place of a row in a pass: a hash of its id, then one of its text (the column _raw)."""
    return F.concat(_id_key(id_column, epoch, seed), F.lpad(F.hex("_raw"), 16, "0"))


def _id_key(id_column: Column, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"))


def leaf_cuts(spark: SparkSession, rows: DataFrame, plan: Plan) -> DataFrame:
    """For each leaf: tokens, budget b, whole passes, and where the prefix of the next pass ends.

    rows: LEAF columns, _id, _raw and _tokens. The prefix has all keys up to cut; cut is null where it has none.
    """
    scratch = Scratch(spark, "mixing")
    leaves = scratch.save(rows.groupBy(*LEAF).agg(F.sum("_tokens").alias("tokens")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    passes = F.when(F.col("tokens") > 0, F.expr("b div tokens")).otherwise(0)
    budgets = leaf_budgets(leaves, plan, total).withColumn("passes", passes)
    budgets = scratch.save(budgets.withColumn("rest", F.col("b") - F.col("passes") * F.col("tokens")))
    keyed = rows.join(budgets, list(LEAF)).withColumn("key", _key(F.col("_id"), F.col("passes"), plan.seed))
    ends = budgets.where("rest > 0").select(*LEAF, F.lit("").alias("end"), F.lit(0).cast("long").alias("before"))
    for digits in DIGITS:
        inner = keyed.join(ends, list(LEAF)).where(F.col("key").startswith(F.col("end"))).withColumn("bin", F.substring("key", 1, digits))
        bins = inner.groupBy(*LEAF, "bin").agg(F.sum("_tokens").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("base"))
        before = F.col("base") + F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bin")) - F.col("n")
        ends = bins.withColumn("before", before).where("before <= rest AND rest < before + n")
        ends = scratch.save(ends.select(*LEAF, F.col("bin").alias("end"), "before"))
    last = keyed.join(ends, list(LEAF)).where(F.col("key").startswith(F.col("end")))
    last = last.groupBy(*LEAF, "key", "before", "rest").agg(F.sum("_tokens").alias("_tokens"))  # rows alike are one, however many they are
    upto = F.col("before") + F.sum("_tokens").over(Window.partitionBy(*LEAF).orderBy("key"))
    inside = last.withColumn("upto", upto).where("upto <= rest").groupBy(*LEAF).agg(F.max("key").alias("inside"))
    # keys of earlier ranges sort before the bare prefix of the last one
    cuts = budgets.join(ends, list(LEAF), "left").join(inside, list(LEAF), "left")
    return scratch.save(cuts.select(*LEAF, "tokens", "b", "passes", F.coalesce("inside", "end").alias("cut")))


def _leaf_of(docs: DataFrame, domain: Column, language: Column, source: Column) -> list[Column]:
    return [F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in zip(LEAF, (domain, language, source), strict=True)]


def _raw(text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{text_col}`")).alias("_raw")


def _copies(plan: Plan) -> Column:
    taken = F.coalesce(_key(F.col("_id"), F.col("passes"), plan.seed) <= F.col("cut"), F.lit(False))
    return F.coalesce(F.col("passes") + taken.cast("long"), F.lit(0)).cast("long")


def decide(spark: SparkSession, docs: DataFrame, plan: Plan, domain: Column, language: Column, source: Column, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """One row per input row: id, domain, language, source, n_tokens and copies, the times it is taken."""
    count = word_count(F.col(f"`{text_col}`")) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), _raw(text_col), *_leaf_of(docs, domain, language, source), count.alias("_tokens"))
    rows = Scratch(spark, "mixing").save(rows)
    dealt = rows.join(leaf_cuts(spark, rows, plan), list(LEAF), "left")
    return dealt.select(F.col("_id").alias(id_col), *LEAF, F.col("_tokens").alias("n_tokens"), _copies(plan).alias("copies"))


def mix(spark: SparkSession, docs: DataFrame, plan: Plan, domain: Column, language: Column, source: Column, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """The rows taken, each as often as it is taken, with all their columns."""
    count = word_count(F.col(f"`{text_col}`")) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), _raw(text_col), *_leaf_of(docs, domain, language, source), count.alias("_tokens"))
    cuts = leaf_cuts(spark, Scratch(spark, "mixing").save(rows), plan)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{id_col}`").alias("_id"), _raw(text_col), *_leaf_of(docs, domain, language, source))
    dealt = packed.join(cuts, list(LEAF)).withColumn("_copies", _copies(plan)).where("_copies > 0")
    return dealt.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_pass")).select("_row.*")
