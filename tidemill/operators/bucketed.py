"""Tables laid out for a join: bucketed and sorted by its key once, so that joins and groups by that key shuffle nothing.

Defined results: null keys are in one bucket and match nothing in joins; rows of any number share a key; an empty table has no files and joins as one; all
columns stay. A hot key is one bucket, as in any table laid out by key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from tidemill.session import Scratch


def bucketed(df: DataFrame, key: str, buckets: int, scratch: Scratch) -> DataFrame:
    """The table saved in `buckets` buckets of a key, sorted by it, one file for each; tables that are to be joined need the same number and kind of key."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.format("parquet").option("path", f"{scratch.path}/{name}")
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return spark.table(name)
