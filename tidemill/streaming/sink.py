"""A keyed sink that a stream can replay: each batch replaces the partitions it touches, under its own number.

A batch writes whole partitions, what they held before with its rows merged in by key, to `data/<partition>/batch=<number>`, and is marked in `commits`
when all are there. A batch reads what was committed before its number only, so that one that comes again after a crash, in part or whole,
makes the same files in place of its own. Readers take each partition's newest committed version. Older versions go by `vacuum`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedSink:
    """Rows by key; of rows of one key the one with the largest `order` stays.

    Defined results: null keys are keys like any other; a null partition is a partition like any other; of equal orders the row that is largest in all its columns stays; a batch
    without rows changes nothing; a sink without batches has no rows.
    """

    def __init__(self, path: str, schema: str, partition: str, keys: list[str], order: list[str]):
        self.path, self.schema, self.partition, self.keys, self.order = path, schema, partition, keys, order

    def upsert(self, rows: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        spark, columns = rows.sparkSession, rows.columns
        rows = self._newest(rows).persist()  # read for its partitions, and again to be merged
        touched = rows.select(F.col(self.partition).alias("touched")).distinct()
        old = self.read(spark, batch_id - 1)
        old = old.join(F.broadcast(touched), F.col(self.partition).eqNullSafe(F.col("touched")), "left_semi") if old is not None else None
        whole = self._newest(rows if old is None else rows.unionByName(old.select(columns))).withColumn("batch", F.lit(batch_id).cast("long"))
        writer = whole.repartition(self.partition, F.pmod(F.xxhash64(*self.keys), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(self.partition, "batch").parquet(f"{self.path}/data")
        spark.range(1).select(F.lit(batch_id).cast("long").alias("number")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/of={batch_id}")
        rows.unpersist()

    def _newest(self, rows: DataFrame) -> DataFrame:
        columns = rows.columns
        best = F.max(F.struct(F.struct(*self.order).alias("o"), F.struct(*columns).alias("r"))).alias("best")
        return rows.groupBy(self.partition, *(k for k in self.keys if k != self.partition)).agg(best).select("best.r.*")

    def _committed(self, spark: SparkSession, upto: int | None) -> list[int]:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            return []
        numbers = spark.read.schema("number long").parquet(f"{self.path}/commits/of=*")
        return sorted(r.number for r in numbers.collect() if upto is None or r.number <= upto)  # a row for each batch

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame | None:
        """The rows as of the last committed batch, or as of batch `upto`; None without batches."""
        done = self._committed(spark, upto)
        if not done:
            return None
        schema = f"{self.schema}, batch long"
        data = spark.read.schema(schema).parquet(f"{self.path}/data").where(F.col("batch") <= done[-1])
        newest = data.groupBy(F.col(self.partition).alias("p")).agg(F.max("batch").alias("b"))
        met = data.join(F.broadcast(newest), F.col(self.partition).eqNullSafe(F.col("p")) & (F.col("batch") == F.col("b")), "left_semi")  # a row for each partition
        return met.drop("batch")

    def vacuum(self, spark: SparkSession) -> int:
        """Delete versions that no reader takes any more; returns how many. Not beside a running batch."""
        done = self._committed(spark, None)
        if not done:
            return 0
        data = spark.read.schema(f"{self.schema}, batch long").parquet(f"{self.path}/data")
        newest = data.where(F.col("batch") <= done[-1]).groupBy(F.col(self.partition).alias("p")).agg(F.max("batch").alias("b"))
        rows = data.join(F.broadcast(newest), F.col(self.partition).eqNullSafe(F.col("p"))).where("batch < b")
        old = {r.f.rsplit("/", 1)[0] for r in rows.select(F.col("_metadata.file_path").alias("f")).distinct().collect()}  # names of folders
        for folder in old:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        return len(old)
