"""CSV and JSON lines by a fixed schema, with rows that don't parse kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAD = "_bad_line"
#: What an empty CSV field is while it is parsed, as Spark takes quoted empty texts for nulls if that is empty too.
NO_VALUE = "\x01no value\x01"


def parsed(spark: SparkSession, path: str, kind: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a csv or json path, and the lines (column line) that don't fit the schema. Nothing is inferred, and files are split among tasks.

    Lines are parsed whole whatever columns are asked for later: Spark's own readers parse those only, so that which rows are bad depends on the query.

    Defined results: a row is a line; an empty CSV field is null, a quoted one an empty text; JSON fields that a line lacks are null, others than the schema's are ignored; a line with too
    few or too many CSV fields, or a value of another type, is bad as a whole; lines of spaces are no rows; a folder of empty files gives none.
    """
    parse = {"csv": F.from_csv, "json": F.from_json}[kind]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD} | ({"emptyValue": "", "nullValue": NO_VALUE, "escape": '"'} if kind == "csv" else {})
    rows = spark.read.text(path).where(F.trim("value") != "").select(parse("value", f"{schema}, `{BAD}` string", options).alias("row"))
    good = rows.where(F.col(f"row.{BAD}").isNull()).select("row.*").drop(BAD)
    return good, rows.where(F.col(f"row.{BAD}").isNotNull()).select(F.col(f"row.{BAD}").alias("line"))


def written(df: DataFrame, path: str, kind: str) -> None:
    """Rows as csv or json lines that `parsed` reads back as they were: nulls and empty texts are kept apart, times keep microseconds, quotes are
    escaped. A line end in a value is escaped in JSON only; in CSV it ends the row, so texts with some belong in JSON."""
    writer = df.write.mode("overwrite").format(kind).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").option("ignoreNullFields", "false")
    writer.options(emptyValue='""', escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").save(path)
