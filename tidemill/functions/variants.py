"""Values without a fixed schema, as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def typed(text: Column) -> Column:
    """A text as a variant: of what its JSON says, or the text itself if it is none; null stays null."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def url_parameters(url: Column) -> Column:
    """A URL's query parameters in order, as an array of structs of a name and a typed variant; repeated names stay, as do names without a value (an empty text).

    Defined results: null, for a null URL; an empty array where there is no query; escapes that can't be decoded stay as they are.
    """
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    decoded = lambda text: F.coalesce(F.try_url_decode(text), text)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    name = lambda p: decoded(F.regexp_extract(p, "^[^=]*", 0))
    return F.transform(pairs, lambda p: F.struct(name(p).alias("name"), typed(decoded(F.regexp_extract(p, "=(.*)$", 1))).alias("value")))


def leaves(df: DataFrame, variant: str, id_col: str) -> DataFrame:
    """The members of each row's variant, objects' by key and arrays' by position: (id, pos, key, value); scalars and nulls give none."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{variant}`").alias("v"))
    return rows.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select("id", "pos", "key", "value")
