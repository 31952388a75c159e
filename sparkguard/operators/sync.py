"""Synchronising tables: in full, by high-water mark, merged, and validated."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkguard.functions.digest import slot
from sparkguard.functions.numbers import number_text
from sparkguard.operators.metrics import at
from sparkguard.operators.transforms import apply_all
from sparkguard.sources.tables import all_equal

MODES = ("source_wins", "target_wins", "merge")


def full(source: DataFrame, steps: list[dict[str, Any]], path: str, as_of: dt.datetime) -> str:
    """Everything, transformed, into a folder named by the time of the run. Returns the folder."""
    folder = f"{path}/{as_of.strftime('%Y%m%d_%H%M%S')}"
    apply_all(source, steps).write.mode("overwrite").parquet(folder)
    return folder


def changed_since(source: DataFrame, modified: str, mark: dt.datetime | None, filters: dict[str, Any] | None = None) -> DataFrame:
    """Rows modified strictly after the mark that equal the filters; both reach the scan."""
    out = source if mark is None else source.where(F.col(modified) > at(mark))
    return out.where(all_equal(filters or {}))


def read_mark(spark: SparkSession, path: str) -> dt.datetime | None:
    """Stored high-water mark, or none before the first run, when there is no such path; any other error is raised."""
    from pyspark.errors import AnalysisException

    try:
        marks = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return marks.agg(F.max("mark")).head()[0]


def incremental(
    source: DataFrame, modified: str, mark_path: str, filters: dict[str, Any] | None, path: str, run: str
) -> DataFrame:
    """Writes the rows since the stored mark, then moves the mark to the newest row seen."""
    spark = source.sparkSession
    rows = changed_since(source, modified, read_mark(spark, mark_path), filters)
    rows.write.mode("overwrite").parquet(f"{path}/{run}")
    written = spark.read.schema(rows.schema).parquet(f"{path}/{run}")
    moved = written.agg(F.max(modified).alias("mark")).where(F.col("mark").isNotNull())
    moved.write.mode("append").parquet(mark_path)
    return written


def merge(source: DataFrame, target: DataFrame, keys: list[str], mode: str = "source_wins") -> DataFrame:
    """Both sides by key. ``merge`` takes the source's values and fills its nulls from the target."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    values = [c for c in source.columns if c not in keys]
    s = source.select(*keys, F.struct(*values).alias("s"))
    g = target.select(*keys, F.struct(*values).alias("g"))
    joined = s.join(g, keys, "full")

    def pick(c: str) -> Column:
        if mode == "merge":
            return F.coalesce(F.col(f"s.{c}"), F.col(f"g.{c}"))
        first, second = ("s", "g") if mode == "source_wins" else ("g", "s")
        return F.when(F.col(first).isNotNull(), F.col(f"{first}.{c}")).otherwise(F.col(f"{second}.{c}"))

    return joined.select(*keys, *[pick(c).alias(c) for c in values])


def _text(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
        return number_text(c)
    return c.cast("string")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free digest, summed from one slice per row."""
    text = F.concat_ws("|", *[F.coalesce(_text(f), F.lit("~")) for f in df.schema.fields])
    piece = slot(F.md5(text.cast("binary")), 0).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(piece), F.lit(0)).cast("decimal(38,0)").cast("string").alias("digest"))


def validate(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Per named pair: counts and digests of both sides, and whether they agree."""
    prints = [
        fingerprint(df).select(F.lit(name).alias("pair"), F.col("rows").alias(f"{side}_rows"), F.col("digest").alias(f"{side}_digest"))
        for name, both in pairs.items()
        for side, df in zip(("source", "target"), both, strict=True)
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), prints)
    every = stacked.groupBy("pair").agg(*[F.max(c).alias(c) for c in ("source_rows", "source_digest", "target_rows", "target_digest")])
    agree = (F.col("source_rows") == F.col("target_rows")) & (F.col("source_digest") == F.col("target_digest"))
    return every.withColumn("valid", agree)
