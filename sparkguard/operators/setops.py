"""Unions over differently shaped stores, and differences between two tables."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def federated(stores: dict[str, Callable[[], DataFrame]], absent: dict[str, str] | None = None) -> DataFrame:
    """The same question to several stores. A store that cannot be asked is left out and named in ``absent`` with its error.

    Asking plans the question; a store that fails later, while rows are read, fails the union.
    """
    answers = []
    for provider, ask in stores.items():
        try:
            answers.append(ask().select(F.lit(provider).alias("provider"), "*"))
        except PySparkException as e:
            log.warning("store %s skipped: %s", provider, type(e).__name__)
            if absent is not None:
                absent[provider] = e.getCondition() or type(e).__name__
    if not answers:
        raise ValueError(f"no store answers: {', '.join(stores)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), answers)


@dataclass(frozen=True)
class Listing:
    """Resources of one kind of one provider; ``rows`` has a name and may have metadata."""

    provider: str
    kind: str
    resource_type: str
    region: str
    rows: DataFrame
    status: str = "available"


def resources(listings: list[Listing]) -> DataFrame:
    """One table of resources with identifiers ``provider:kind:name``."""
    shaped = []
    for item in listings:
        meta = F.col("metadata") if "metadata" in item.rows.columns else F.lit(None).cast("map<string,string>")
        shaped.append(
            item.rows.select(
                F.concat(F.lit(f"{item.provider}:{item.kind}:"), "name").alias("identifier"),
                F.lit(item.provider).alias("provider"),
                F.lit(item.resource_type).alias("resource_type"),
                "name",
                F.lit(item.region).alias("region"),
                F.lit(item.status).alias("status"),
                meta.alias("metadata"),
            )
        )
    return reduce(DataFrame.unionByName, shaped)


def diff(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: new, gone, changed or same. One shuffle join on the key; values compare null-safely."""
    values = [c for c in source.columns if c not in keys]
    s = source.select(*keys, F.struct(*values).alias("s"))
    g = target.select(*keys, F.struct(*values).alias("g"))
    same = reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"g.{c}")) for c in values], F.lit(True))
    change = F.when(F.col("g").isNull(), "new").when(F.col("s").isNull(), "gone").when(same, "same").otherwise("changed")
    return s.join(g, keys, "full").select(*keys, change.alias("change"))
