"""Join helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on equally named keys that may be null; the keys of the left side stay."""
    if not keys:
        raise ValueError("no join keys")
    right_columns = [c for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(f"`{k}`").alias(f"__{k}") for k in keys], *[F.col(f"`{c}`") for c in right_columns])
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__{k}" for k in keys])
