"""A corpus from documents: drop toxic ones, dedup exactly and nearly, mix to weights, tokenise.

Each stage reads what the one before kept, as a table of its own, so that a lost executor costs
the stage in hand at most. Sources' domains follow from their names; a corpus that was just
deduplicated isn't repeated, so mixing takes one pass at most, and 0.8 of the tokens.

Defined results, of each stage and so of all: a null text counts as empty; texts of any length are taken whole; rows with a
null id take part, and come after others where the smallest id stays; rows that only share an id are documents of their own, but for
mixing, which takes rows that share one together; of equal texts the longest as written stays, then the smallest id; rows
alike in all are one; an empty table gives an empty result of the same columns; extra columns stay, whatever their names, until the last
stage, whose columns are doc_id, n_tokens, ids_sha256, decoded_sha256 and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe_codec, exact_dedup, mixing, simhash_similar, toxicity
from tidemill.llm.queries import DOMAIN
from tidemill.session import Scratch, share_code
from tidemill.sources import table

PLAN = mixing.Plan(domains={"d0": 4, "d1": 3, "d2": 2, "d3": 1}, languages={"en": 5, "de": 2, "fr": 2, "es": 1}, share=0.8, epochs=1, seed=11)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7, by a model fitted on labelled ones outside the held-out fold."""
    return toxicity.keep_clean(share_code(spark), docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal without white space."""
    return exact_dedup.exact_dedup(spark, docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of five-word shingles of 0.8 or more."""
    return simhash_similar.near_dedup(share_code(spark), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the budgets of their domain, language and source."""
    return mixing.mix(spark, docs, PLAN, F.expr(DOMAIN), F.col("lang"), F.col("source"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, their digest, and that of the text decoded from them."""
    share_code(spark)
    return bpe_codec.round_trip(docs, with_ids=True)


STAGES = [("toxicity", clean), ("exact_dedup", unique), ("simhash_dedup", distinct), ("mixing", mixed), ("bpe_codec", encoded)]

#: A label model, shingle hashes and merges are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch, docs = Scratch(share_code(spark), "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
