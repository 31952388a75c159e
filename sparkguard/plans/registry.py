"""Registry of the runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkguard.plans.fixtures import DUCK, SPARK
from sparkguard.session import shared_dir, use_utc

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Inputs:
    """Lazy access to the parquet tables of one folder and to the projections over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def fx(self, name: str) -> DataFrame:
        text, sources = SPARK[name]
        for source in sources:
            self.table(source).createOrReplaceTempView(source)
        return self.spark.sql(text)

    def scratch(self, label: str) -> str:
        """A fresh folder for tables written between two steps."""
        import uuid

        return f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"


Build = Callable[[Inputs], DataFrame]
_BUILDERS: dict[str, Build] = {}
_SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None, fx: str = "") -> Callable[[Build], Build]:
    """Register ``build`` under ``key``; ``sql`` is its twin, ``fx`` the projections the twin reads."""

    def register(build: Build) -> Build:
        if key in _BUILDERS:
            raise ValueError(f"duplicate query {key}")
        _BUILDERS[key] = build
        if sql is not None:
            _SQL[key] = with_fixtures(sql, fx.split())
        return build

    return register


def with_fixtures(sql: str, names: list[str]) -> str:
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"fx_{n} as ({DUCK[n].strip()})" for n in names)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[len('with '):]}"
    return f"with {ctes}\n{body}"


def plain_times(df: DataFrame) -> DataFrame:
    """Zone-free timestamps in results, so that readers see the UTC wall clock."""
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp_ntz"))
    return df


def builders() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            use_utc(spark)
            return plain_times(build(Inputs(spark, sf_dir)))

        return run

    return {k: bind(b) for k, b in _BUILDERS.items()}


def twins() -> dict[str, str]:
    return dict(_SQL)
