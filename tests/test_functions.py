"""Functions of one's own on nulls, empty and large values."""

from pyspark.sql import functions as F

from tidemill.functions import check_digits, ratio


def test_check_digits(spark):
    numbers = [0, 1, 97, 123456789, 2**62, None]
    rows = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", check_digits("n").alias("d"))
    assert all((r.d is None) if r.n is None else (r.n * 100 + r.d) % 97 == 1 and 2 <= r.d <= 98 for r in rows.collect())
    assert rows.limit(0).count() == 0


def test_ratio(spark):
    rows = spark.createDataFrame([(1, 2), (1, 0), (None, 2)], "a int, b int").select(ratio(F.col("a"), F.col("b")).alias("r"))
    assert [r.r for r in rows.collect()] == [0.5, None, None]
