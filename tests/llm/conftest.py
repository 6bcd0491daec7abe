"""Documents of odd kinds that every operator must take."""

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns named as results or helpers of operators are.
CLASHING = ["_id", "_row", "_text", "score", "kept", "spans", "ids", "_word", "fp", "component", "bin", "cut", "tokens", "copies", "lines_removed", "licenses", "_own", "_gone", "domain", "a.b"]


@pytest.fixture(scope="session")
def odd_rows():
    long = "word " * 30_000 + "end"
    return [
        (1, "The quick brown fox jumps over the lazy dog", "en", "src1", 43),
        (2, "The quick brown  fox\njumps over the lazy dog", "en", "src2", 44),
        (3, None, None, None, None),
        (4, "", "de", "src0", 0),
        (5, " \t\n", "de", "src0", 3),
        (6, long, "fr", "src3", len(long)),
        (7, "The quick brown fox jumps over the lazy dog", "en", "src1", 43),
        (7, "The quick brown fox jumps over the lazy dog", "en", "src1", 43),
        (None, "no id here", "en", None, 10),
        (9, "ünïcödé \u0000 \x1c \x85 　 😀 é <|endoftext|> \x01", None, "web", 9),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(odd):
    from pyspark.sql import functions as F

    return odd.select("*", *(F.lit("x").alias(c) for c in CLASHING))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
