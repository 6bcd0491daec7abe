"""Exact dedup in two Bloom passes, with DataFrame functions only.

Texts are equal when identical after deleting every character of [\\x20\\x09-\\x0D].

Pass one hashes each normalised text to two of the 64 bits of a word of the filter, and counts each
bit with map-side combining: only numbers of bits and counts shuffle, of which there are `filter_words` x
64 at most from a task and in all, however many rows there are. Bits that came more than once are a
blocked Bloom filter of possibly repeated hashes. It has at most `filter_words` rows of two longs,
whatever the input, which proves the size of what is broadcast. Pass two looks each row up. Rows of
which the filter lacks a bit are unique and pass straight through; only the rest shuffle, by their
SHA-256, so false hits only cost traffic.

Defined results: a null text counts as empty; empty texts equal one another; a null id comes
after all others, and its keep_id may be null; repeated rows with the same id and text share
one decision in `exact_groups`, while `exact_dedup` keeps one of them; an empty table gives an
empty result; other columns stay as they are, whatever their names, since rows travel packed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import WHITE
from tidemill.session import Scratch

#: Rows of the filter at most; each is two longs.
FILTER_WORDS = 1 << 20


def normal(text: Column) -> Column:
    """The text without white space."""
    for space in WHITE:
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space, lowercase hex."""
    return F.sha2(normal(text), 256)


def _probe(hashed: Column, words: int) -> tuple[Column, list[Column]]:
    """The filter's word for a hash, and which two bits of that word."""
    first = F.shiftrightunsigned(hashed, 30).bitwiseAND(63)
    other = (first + 1 + F.pmod(F.shiftrightunsigned(hashed, 37), F.lit(63))).bitwiseAND(63)
    return hashed.bitwiseAND(words - 1), [first, other]


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))


def repeated_filter(hashes: DataFrame, filter_words: int = FILTER_WORDS) -> DataFrame:
    """Pass one: words and known bits of hashes (the column _h) that may be repeated."""
    if filter_words < 1 or filter_words & (filter_words - 1):
        raise ValueError("filter_words must be a power of two")
    word, bits = _probe(F.col("_h"), filter_words)
    seen = hashes.select(F.explode(F.array(*(word * 64 + bit for bit in bits))).alias("_at")).groupBy("_at").count()
    return _words(seen.where("count > 1"))


def _words(bits: DataFrame) -> DataFrame:
    return bits.groupBy(F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(_bit(F.col("_at").bitwiseAND(63))).alias("_known"))


def filter_of(hashes: DataFrame, filter_words: int = FILTER_WORDS) -> DataFrame:
    """A filter that knows all of some hashes (the column _h)."""
    word, bits = _probe(F.col("_h"), filter_words)
    return _words(hashes.select(F.explode(F.array(*(word * 64 + bit for bit in bits))).alias("_at")).distinct())


def flag(rows: DataFrame, known: DataFrame, filter_words: int = FILTER_WORDS) -> DataFrame:
    """Pass two: adds _again, true where the filter knows the row's hash _h."""
    word, (first, other) = _probe(F.col("_h"), filter_words)
    both = _bit(first).bitwiseOR(_bit(other))
    looked = rows.withColumn("_word", word).join(F.broadcast(known), "_word", "left")
    return looked.withColumn("_again", F.coalesce(F.col("_known").bitwiseAND(both) == both, F.lit(False))).drop("_word", "_known")


def _winners(rows: DataFrame) -> DataFrame:
    """Of each _sha: the row that stays (most code points, then smallest id, then smallest _raw) and the group's size."""
    rank = F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_raw").alias("r"))
    return rows.groupBy("_sha").agg(F.min(rank).alias("_best"), F.count(F.lit(1)).alias("_size"))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _len, _raw (a hash of the text as it is), _sha of each row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.length(text).alias("_len"), F.xxhash64(text).alias("_raw"), digest(text).alias("_sha"))


def exact_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_words: int = FILTER_WORDS) -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept and text_sha256.

    Groups' winners are a table of their own, so that the join with them can split a hot group.
    """
    scratch = Scratch(spark, "exact")
    rows = scratch.save(_digests(docs, id_col, text_col)).withColumn("_h", F.xxhash64("_sha"))
    known = scratch.save(repeated_filter(rows, filter_words))
    flagged = flag(rows, known, filter_words)
    through = flagged.where(~F.col("_again")).select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256")
    )
    again = flagged.where("_again").select("_id", "_len", "_raw", "_sha")
    stays = F.col("_id").eqNullSafe(F.col("_best.i")) & (F.col("_len") == -F.col("_best.l"))
    dealt = again.join(scratch.save(_winners(again)), "_sha").select(
        F.col("_id").alias(id_col), F.col("_best.i").alias("keep_id"), F.col("_size").alias("group_size"), stays.alias("kept"), F.col("_sha").alias("text_sha256")
    )
    return through.unionByName(dealt)


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_words: int = FILTER_WORDS) -> DataFrame:
    """The rows that stay, with all their columns.

    Texts are normalised once, for digests that are kept beside ids and hashes of the texts as they are. A second
    filter of the same bounded size knows the hashes of rows that may be repeated, so that reading the texts again
    takes no more than that hash: rows it doesn't know pass through, and only the rest shuffle.
    """
    scratch = Scratch(spark, "exact")
    rows = scratch.save(_digests(docs, id_col, text_col))
    by_sha = rows.withColumn("_h", F.xxhash64("_sha"))
    again = flag(by_sha, repeated_filter(by_sha, filter_words), filter_words).where("_again")
    known = scratch.save(filter_of(again.select(F.col("_raw").alias("_h")), filter_words))
    best = scratch.save(_winners(flag(rows.withColumn("_h", F.col("_raw")), known, filter_words).where("_again")))
    best = best.select("_sha", F.col("_best.i").alias("_keep"), (-F.col("_best.l")).alias("_most"), F.col("_best.r").alias("_kept"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_h"), F.length(text).alias("_len"))
    flagged = flag(packed, known, filter_words)
    # a group's rows meet their winner by hash, id and length, so that no task gets a whole group
    met = flagged.where("_again").join(best, (F.col("_h") == F.col("_kept")) & F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_len") == F.col("_most")))
    once = met.groupBy("_sha").agg(F.first("_row").alias("_row"))
    return flagged.where(~F.col("_again")).select("_row.*").unionByName(once.select("_row.*"))
