"""Tables by name: parquet and JDBC reads, external tables, document lookups, chunked writes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Usual rows of a document lookup and of an ad-hoc query, and rows of a chunk.
FIND_LIMIT = 1000
ADHOC_LIMIT = 10
CHUNK_ROWS = 10_000


def scan(spark: SparkSession, path: str, columns: dict[str, str] | None = None, fmt: str = "parquet") -> DataFrame:
    """A table from files; with ``columns`` only those, cast to the given types."""
    df = spark.read.format(fmt).load(path)
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()]) if columns else df


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 64,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A table of a relational store, read by ranges of ``partition_column`` in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(properties or {}))
    if partition_column is not None:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    return reader.load()


def all_equal(wanted: dict[str, Any]) -> Column:
    """``k = v`` pairs joined by AND; none means every row."""
    hit = F.lit(True)
    for k, v in wanted.items():
        hit = hit & (F.col(k) == F.lit(v))
    return hit


def find(df: DataFrame, wanted: dict[str, Any], order: list[str], limit: int | None = None) -> DataFrame:
    """Documents in ``order`` that equal the filter; the first ``limit`` if one is given."""
    out = df.where(all_equal(wanted)).orderBy(*order)
    return out if limit is None else out.limit(limit)


def first_rows(df: DataFrame, limit: int, order: list[str] | None = None) -> DataFrame:
    """The first rows of an ad-hoc result; the caller names how many."""
    return (df.orderBy(*order) if order else df).limit(limit)


def external_table(spark: SparkSession, name: str, columns: dict[str, str], location: str, fmt: str = "parquet") -> DataFrame:
    """Registers existing files as a table with the given columns; the files stay where they are."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    listed = ", ".join(f"`{c}` {t}" for c, t in columns.items())
    spark.sql(f"CREATE TABLE {name} ({listed}) USING {fmt} LOCATION '{location}'")
    return spark.table(name)


def write_chunks(df: DataFrame, path: str, rows: int = CHUNK_ROWS, fmt: str = "parquet") -> None:
    """Files of at most ``rows`` rows, written where the rows are."""
    df.write.option("maxRecordsPerFile", rows).mode("overwrite").format(fmt).save(path)
