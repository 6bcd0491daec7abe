"""Column expressions that several queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revenue() -> Column:
    """Price of a line after its discount."""
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def ratio(top: Column, bottom: Column, digits: int = 4) -> Column:
    """A rounded quotient; null where the divisor is zero or null."""
    return F.round(F.try_divide(top.cast("double"), bottom.cast("double")), digits)


def check_digits(number: str) -> Column:
    """Two check digits of whole numbers, such that number and digits leave 1 when divided by 97; null for null."""
    return (98 - F.col(number) % 97 * 100 % 97).cast("int")  # the rest first, as the product could overflow
