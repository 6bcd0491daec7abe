"""Session helpers: local sessions, shared scratch tables, code for Python workers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(name: str = "tidemill", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return share_code(spark)


def share_code(spark: SparkSession) -> SparkSession:
    """Put this checkout on the Python workers' path (clusters that ship it by --py-files lose nothing)."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = ":".join([ROOT, *parts])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Only where a local session leaves it unset is a temporary folder made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidemill-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
        atexit.register(_remove, spark, root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended before the interpreter; its folder stays
        pass


class Scratch:
    """Parquet tables in the shared folder that cut lineage and outlive lost executors.

    Results are lazy, so a table a result still reads stays until the interpreter ends;
    `drop` removes those that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}
        atexit.register(_remove, spark, self.path)

    def save(self, df: DataFrame, codec: str | None = None) -> DataFrame:
        """The table, read back. codec: of its files, for tables that hold texts (zstd takes less disk); none is Spark's own."""
        path = f"{self.path}/{self.n}"
        self.n += 1
        (df.write.option("compression", codec) if codec else df.write).mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            _remove(self.spark, path)
