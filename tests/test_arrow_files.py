"""Tables of Arrow files: round trips, filters that leave files out, commits."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tidemill.session import Scratch
from tidemill.sources.arrow_files import NAME, register


@pytest.fixture
def path(spark):
    register(spark)
    return f"{Scratch(spark, 'arrow').path}/{uuid.uuid4().hex}"


def read(spark, path, schema=None):
    reader = spark.read.format(NAME)
    return (reader.schema(schema) if schema else reader).load(path)


def odd(spark):
    rows = [(i, None if i % 7 == 0 else i / 2, None if i % 5 == 0 else "" if i % 3 == 0 else f"é{i:03}") for i in range(100)]
    rows += [(100, float("nan"), "z"), (101, float("inf"), None), (None, -0.0, "null id")]
    df = spark.createDataFrame(rows, "id long, v double, `a.b` string")
    return df.select("*", F.timestamp_seconds(F.col("id") * 3600).alias("at"), F.to_timestamp_ntz(F.timestamp_seconds("id")).alias("ntz"), F.array(F.struct("v")).alias("nested"), F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("day"))


def test_round_trip_of_odd_rows(spark, path):
    df = odd(spark)
    df.repartition(5).write.format(NAME).option("ranges", "id,v,a.b,at,ntz,day").mode("overwrite").save(path)
    out = read(spark, path)
    assert [f.simpleString() for f in out.schema] == [f.simpleString() for f in df.schema]
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    picked = read(spark, path, "`a.b` string, id long")
    assert picked.columns == ["a.b", "id"] and sorted(map(str, picked.collect())) == sorted(map(str, df.select("`a.b`", "id").collect()))


CASES = [
    "id = 50", "id > 95", "id >= 95", "id < 3", "id <= 3", "id IN (1, 99)", "id IS NULL", "id IS NOT NULL AND id < 5", "id > 30 AND id < 40", "NOT id > 5", "v > 1e9", "v = double('NaN')", "v <= 0",
    "`a.b` = 'é050'", "`a.b` LIKE 'é09%'", "day < DATE '2024-01-05'", "at >= TIMESTAMP '1970-01-05 00:00:00'", "ntz = TIMESTAMP_NTZ '1970-01-01 00:00:07'", "id = 5000", "id <=> 7", "nested[0].v = 1",
]


def test_filters_give_the_rows_they_should(spark, path):
    df = odd(spark)
    df.repartitionByRange(8, "id").write.format(NAME).option("ranges", "id,v,a.b,at,ntz,day").mode("overwrite").save(path)
    for case in CASES:
        assert sorted(map(str, read(spark, path).where(case).collect())) == sorted(map(str, df.where(case).collect())), case


def parts(df):
    return df.rdd.getNumPartitions()


def test_filters_leave_files_out(spark, path):
    df = odd(spark)
    df.repartitionByRange(8, "id").write.format(NAME).option("ranges", "id,day").mode("overwrite").save(path)
    assert parts(read(spark, path)) == 8
    assert parts(read(spark, path).where("id = 50")) == 1
    assert parts(read(spark, path).where("id > 30 AND id < 60")) in (3, 4)
    assert parts(read(spark, path).where("day >= DATE '2024-04-09'")) == 1
    assert parts(read(spark, path).where("id IS NULL")) == 1
    assert parts(read(spark, path).where("v = 1")) == 8  # no range was kept


def test_append_overwrite_and_what_tasks_left(spark, path):
    first, more = spark.range(10), spark.range(10, 30)
    first.write.format(NAME).mode("append").save(path)
    more.write.format(NAME).option("ranges", "id").mode("append").save(path)
    assert sorted(r.id for r in read(spark, path).where("id >= 5").collect()) == list(range(5, 30))
    local = path.removeprefix("file://")
    one = next(f for f in os.listdir(local) if not f.startswith("manifest"))
    with open(f"{local}/{one}", "rb") as whole, open(f"{local}/left-by-a-lost-task.arrow", "wb") as half:
        half.write(whole.read()[:50])
    assert read(spark, path).count() == 30
    spark.range(3).coalesce(1).write.format(NAME).mode("overwrite").save(path)
    assert sorted(r.id for r in read(spark, path).collect()) == [0, 1, 2] and one not in os.listdir(local)
    with pytest.raises(Exception, match="another schema"):
        spark.range(3).select(F.col("id").cast("string")).write.format(NAME).mode("append").save(path)
    assert read(spark, path).count() == 3


def test_a_failed_write_changes_nothing(spark, path):
    spark.range(5).write.format(NAME).mode("append").save(path)
    with pytest.raises(Exception, match="stop here"):
        spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("stop here")).cast("long")).otherwise(F.col("id")).alias("id")).write.format(NAME).mode("overwrite").save(path)
    assert read(spark, path).count() == 5


def test_tables_without_rows(spark, path):
    odd(spark).limit(0).write.format(NAME).option("ranges", "id").mode("overwrite").save(path)
    out = read(spark, path)
    assert out.columns == odd(spark).columns and out.count() == 0 and out.where("id > 4").count() == 0
    with pytest.raises(Exception, match="no table of Arrow files"):
        read(spark, f"{path}-none")
