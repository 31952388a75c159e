"""Sampled, masked copies of related tables whose foreign keys still resolve."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkguard.functions.digest import digest, slot
from sparkguard.operators.masking import keyword_mask
from sparkguard.operators.ranking import positions

# Rows of a table kept in a copy, and tables of a level that are copied at once.
SAMPLE_ROWS = 1000
CONCURRENT_TABLES = 4
# Keys of a parent copy that are held as one array in the plan (a few megabytes at most).
ARRAY_KEYS = 100_000


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class TableInfo:
    name: str
    primary_key: tuple[str, ...]
    foreign_keys: tuple[ForeignKey, ...] = field(default=())


def levels(tables: list[TableInfo]) -> dict[str, int]:
    """Level per table so that parents come first; only names and key definitions are needed.

    Self references do not count, and a cycle ends after as many rounds as there are tables.
    """
    out = {t.name: 0 for t in tables}
    edges = [(t.name, fk.parent) for t in tables for fk in t.foreign_keys if fk.parent != t.name and fk.parent in out]
    for _ in tables:
        for child, parent in edges:
            out[child] = max(out[child], min(out[parent] + 1, len(tables)))
    return out


def dependency_levels(spark: SparkSession, tables: list[TableInfo]) -> DataFrame:
    return spark.createDataFrame(list(levels(tables).items()), "table_name string, level int")


def processing_order(tables: list[TableInfo]) -> list[TableInfo]:
    """Tables parents first, by level and name."""
    level = levels(tables)
    return sorted(tables, key=lambda t: (level[t.name], t.name))


def sample(df: DataFrame, info: TableInfo, key: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The ``rows`` rows with the smallest keyed digest of their key: repeatable, and all rows of a small table.

    The table's row count gives the share of digests to look at, with ten standard deviations to spare; it is part of the plan,
    so little more than ``rows`` rows of the table go on to the exact cut, however large the table is.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in info.primary_key])
    total = df.agg(F.count(F.lit(1))).scalar()
    share = (rows + 10 * math.sqrt(rows) + 100) * float(2**32) / F.nullif(total, F.lit(0))
    drawn = df.withColumn("_d", digest(text, key, info.name))
    near = drawn.where((slot(F.col("_d"), 0) < share) | (total <= rows))
    return near.orderBy("_d", *info.primary_key).limit(rows).drop("_d")


def fix_foreign_key(child: DataFrame, fk: ForeignKey, parents: DataFrame, key: str, most: int = SAMPLE_ROWS) -> DataFrame:
    """Keys that the parent copy holds stay; others become one it does hold, drawn from the value's digest; none gives null.

    ``most`` is how many keys the copy may have. Up to ARRAY_KEYS of them are one sorted array in the plan, read by position; the query fails
    if there turn out to be more than promised. Larger copies are numbered in ranges and joined. Either way the same key is drawn.
    """
    keys = parents.select(F.col(fk.parent_column).alias("_pk")).where(F.col("_pk").isNotNull()).distinct()
    columns, value = child.columns, F.col(fk.column)
    kept = child.join(keys, value == F.col("_pk"), "left")
    draw = slot(digest(F.coalesce(value.cast("string"), F.lit("")), key, fk.column), 0)
    if most <= ARRAY_KEYS:
        found = keys.limit(most + 1).agg(F.array_sort(F.collect_list("_pk")).alias("k"))
        message = F.lit(f"{fk.parent}: more keys than the {most} that were promised")
        spares = found.select(F.when(F.size("k") > most, F.raise_error(message)).otherwise(F.col("k"))).scalar()
        spare = F.when(F.col("_pk").isNull() & (F.size(spares) > 0), F.element_at(spares, (draw % F.size(spares) + 1).cast("int")))
        out = kept.withColumn("_spare", spare)
    else:
        numbered = positions(keys, [], ["_pk"]).select(F.col("before").alias("_i"), F.col("_pk").alias("_spare"))
        n = keys.agg(F.count(F.lit(1))).scalar()
        # Rows that need no spare key get a spread-out index that matches none, instead of meeting as nulls.
        idle = -1 - F.pmod(F.xxhash64(*columns), F.lit(1_000_000))
        out = kept.withColumn("_i", F.when(F.col("_pk").isNull() & (n > 0), draw % n).otherwise(idle)).join(numbered, "_i", "left")
    fixed = F.coalesce("_pk", "_spare").cast(child.schema[fk.column].dataType)
    return out.select(*[fixed.alias(c) if c == fk.column else F.col(c) for c in columns])


def keep_with_parents(child: DataFrame, fk: ForeignKey, parents: DataFrame) -> DataFrame:
    """Strict integrity: only child rows whose parent is in the copy."""
    keys = parents.select(F.col(fk.parent_column).alias("_pk")).distinct()
    return child.join(keys, child[fk.column] == F.col("_pk"), "left_semi")


def mask(df: DataFrame, info: TableInfo, key: str) -> DataFrame:
    """Keyword masks; primary and foreign keys stay."""
    return keyword_mask(df, key, [*info.primary_key, *[fk.column for fk in info.foreign_keys]])


def replicate(
    sources: dict[str, DataFrame],
    tables: list[TableInfo],
    path: str,
    key: str,
    rows: int = SAMPLE_ROWS,
    concurrent: int = CONCURRENT_TABLES,
) -> dict[str, DataFrame]:
    """Each table sampled, masked, repaired and written once, parents first; the written copies come back.

    Tables of one level do not depend on each other: up to ``concurrent`` of them are copied side by side. A parent that is not part of the copy
    leaves its keys unchanged.
    """
    spark = next(iter(sources.values())).sparkSession
    level = levels(tables)
    copies: dict[str, DataFrame] = {}

    def copy(info: TableInfo) -> DataFrame:
        out = mask(sample(sources[info.name], info, key, rows), info, key)
        for fk in info.foreign_keys:
            if fk.parent in copies and level[fk.parent] < level[info.name]:
                out = fix_foreign_key(out, fk, copies[fk.parent], key, rows)
        out.write.mode("overwrite").parquet(f"{path}/{info.name}")
        return spark.read.schema(out.schema).parquet(f"{path}/{info.name}")

    with ThreadPoolExecutor(concurrent) as pool:
        for n in sorted(set(level.values())):
            now = sorted((t for t in tables if level[t.name] == n), key=lambda t: t.name)
            copies |= dict(zip([t.name for t in now], pool.map(copy, now), strict=True))
    return copies


def run_log(copies: dict[str, DataFrame], run: str) -> DataFrame:
    """Rows copied per table of a run."""
    out = None
    for name, df in copies.items():
        one = df.agg(F.count(F.lit(1)).alias("rows_copied")).select(F.lit(run).alias("run"), F.lit(name).alias("table_name"), "rows_copied")
        out = one if out is None else out.unionByName(one)
    return out


def replication_status(log: DataFrame) -> DataFrame:
    """Per run: tables, rows, duration and rates from a log of (run, table_name, rows_copied, started_at, ended_at)."""
    out = log.groupBy("run").agg(
        F.count(F.lit(1)).alias("tables_processed"),
        F.sum("rows_copied").alias("rows_copied"),
        F.min("started_at").alias("s"),
        F.max("ended_at").alias("e"),
    )
    seconds = (F.unix_micros(F.col("e").cast("timestamp")) - F.unix_micros(F.col("s").cast("timestamp"))) / 1_000_000
    out = out.withColumn("duration_seconds", seconds).drop("s", "e")
    timed = F.col("duration_seconds") > 0
    return out.withColumn("tables_per_second", F.when(timed, F.col("tables_processed") / F.col("duration_seconds"))).withColumn(
        "rows_per_second", F.when(timed, F.col("rows_copied") / F.col("duration_seconds"))
    )
