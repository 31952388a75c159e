"""Number text that reads the same on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(value: Column) -> Column:
    """Six decimals, no exponent."""
    return value.cast("decimal(38,6)").cast("string")


def decimals(value: Column) -> Column:
    """Decimal places that carry information, at least one."""
    tail = F.regexp_replace(F.substring_index(number_text(value), ".", -1), "0+$", "")
    return F.greatest(F.lit(1), F.length(tail))


def magnitude(value: Column) -> Column:
    """Order of magnitude of the integer part; values below one count as order zero."""
    return F.length(F.floor(F.abs(value)).cast("decimal(38,0)").cast("string")) - 1
