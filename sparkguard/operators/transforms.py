"""Ordered table transformations described as data."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CUSTOM: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    """Makes a DataFrame function available to ``custom`` steps."""
    _CUSTOM[name] = fn


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def filter_rows(df: DataFrame, expression: str) -> DataFrame:
    return df.where(expression)


def aggregate(df: DataFrame, group_by: list[str], aggregations: dict[str, str]) -> DataFrame:
    """Keys stay columns; each aggregated column keeps its name."""
    return df.groupBy(*group_by).agg(*[F.expr(f"{fn}(`{c}`)").alias(c) for c, fn in aggregations.items()])


def apply_step(df: DataFrame, step: dict[str, Any]) -> DataFrame:
    kind = step["type"]
    if kind == "rename":
        return rename(df, step["mapping"])
    if kind == "filter":
        return filter_rows(df, step["expression"])
    if kind == "aggregate":
        return aggregate(df, step["group_by"], step["aggregations"])
    if kind == "custom":
        return df.transform(_CUSTOM[step["function"]])
    raise ValueError(f"unknown transformation {kind}")


def apply_all(df: DataFrame, steps: list[dict[str, Any]]) -> DataFrame:
    return reduce(apply_step, steps, df)
