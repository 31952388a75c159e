"""Catalogs of tables and columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_SCHEMA = "dbo"


def discover(spark: SparkSession, schema_name: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Columns, types, nullability and row count of every table, ordered by schema and name."""
    rows = [
        (schema_name, name, f.name, i + 1, f.dataType.simpleString(), f.nullable)
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    layout = "schema_name string, table_name string, column_name string, ordinal int, data_type string, nullable boolean"
    columns = spark.createDataFrame(rows, layout)
    counts = reduce(
        DataFrame.unionAll,
        [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()],
    )
    return columns.join(counts, "table_name").orderBy("schema_name", "table_name", "ordinal").select("schema_name", *[c for c in columns.columns if c != "schema_name"], "row_count")


def unified(stores: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Column rows of several stores, one row per table with its (column, type) pairs in order.

    The list of a table is as long as the table is wide.
    """
    tagged = [df.withColumn("provider", F.lit(p)).withColumn("format", F.lit(fmt)) for p, (df, fmt) in stores.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    pairs = F.array_sort(F.collect_list(F.struct("ordinal", "column_name", "data_type")))
    return every.groupBy("provider", "format", "database_name", "table_name").agg(pairs.alias("columns"))


def lookup(catalog: DataFrame, table: str, default_schema: str = DEFAULT_SCHEMA) -> DataFrame:
    """Columns of ``schema.table``; a bare name is looked up in the default schema."""
    schema, _, name = table.rpartition(".")
    return catalog.where((F.col("database_name") == (schema or default_schema)) & (F.col("table_name") == name))


def pick_tables(catalog: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    out = catalog.where(F.col("table_name").isin(include)) if include else catalog
    return out.where(~F.col("table_name").isin(exclude)) if exclude else out


def target_type(source_type: Column) -> Column:
    """Type of the copy, by what the source type's name contains; earlier lines win."""
    low = F.lower(source_type)
    # Fragments and the types they lead to, in order.
    return (
        F.when(low.contains("int"), "Integer")
        .when(low.contains("char"), "String(255)")
        .when(low.contains("text"), "Text")
        .when(low.contains("float") | low.contains("real"), "Float")
        .when(low.contains("bool") | low.contains("bit"), "Boolean")
        .when(low.contains("date") | low.contains("time"), "DateTime")
        .otherwise("String(255)")
    )


def infer_documents(documents: DataFrame, column: str) -> DataFrame:
    """Fields of JSON documents over all rows: type name, or ``mixed`` where documents differ.

    Types are counted per (field, type) first, so a group is a handful of rows whatever the collection.
    """
    parsed = documents.select(F.parse_json(column).alias("v"))
    fields = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer())).select("key", "value")
    found = F.regexp_extract(F.schema_of_variant("value"), r"^(\w+)", 1)
    # JSON value types and their names.
    names = {"BIGINT": "int", "DECIMAL": "float", "DOUBLE": "float", "STRING": "str", "BOOLEAN": "bool", "VOID": "NoneType", "OBJECT": "dict", "ARRAY": "list"}
    named = F.coalesce(*[F.when(found == k, v) for k, v in names.items()], F.lower(found))
    kinds = fields.select(F.col("key").alias("field"), named.alias("kind")).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.groupBy("field").agg(
        F.when(F.count(F.lit(1)) == 1, F.max("kind")).otherwise("mixed").alias("type"),
        F.lit(True).alias("nullable"),
        (F.first("field") == "_id").alias("primary_key"),
        F.sum("n").alias("documents"),
    )
