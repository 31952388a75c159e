"""Encrypted row backups, restores, and artifact layouts."""

from __future__ import annotations

import datetime as dt
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what the backup key is derived for.
PURPOSE = b"row backup"


def backup_key(key: str) -> Column:
    """The encryption key, derived on the driver: plans hold it, but not the secret. See ``spark.redaction.string.regex``."""
    return F.lit(hmac.new(key.encode(), PURPOSE, "sha256").digest())


PREFIX_COLUMNS = ["user_id", "session_id", "ts_prefix"]


def encrypted_rows(df: DataFrame, key: str, as_of: dt.datetime, encrypt: bool = True) -> DataFrame:
    """Each row as JSON, AES-GCM encrypted, with the backup's time and source columns."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    payload = F.base64(F.aes_encrypt(text, backup_key(key), F.lit("GCM"))) if encrypt else text
    return df.select(
        payload.alias("payload"),
        F.lit(encrypt).alias("encrypted"),
        F.lit(as_of.strftime("%Y%m%d_%H%M%S")).alias("backup_ts"),
    )


def write_backup(df: DataFrame, path: str, key: str, as_of: dt.datetime, source: str, encrypt: bool = True) -> None:
    rows = encrypted_rows(df, key, as_of, encrypt).withColumn("source", F.lit(source))
    rows.write.mode("append").partitionBy("source", "backup_ts").parquet(path)


def restored(rows: DataFrame, schema: str, key: str) -> DataFrame:
    """Rows back from their JSON; text that was not encrypted passes through."""
    opened = F.aes_decrypt(F.unbase64("payload"), backup_key(key), F.lit("GCM")).cast("string")
    text: Column = F.when(F.col("encrypted"), opened).otherwise(F.col("payload"))
    return rows.select(F.from_json(text, schema).alias("r")).select("r.*")


def read_backup(spark: SparkSession, path: str, schema: str, key: str, source: str) -> DataFrame:
    return restored(spark.read.parquet(path).where(F.col("source") == source), schema, key)


def write_artifacts(df: DataFrame, path: str) -> None:
    """One folder per user, session and time prefix. The rebalance splits a folder that holds much."""
    df.hint("rebalance", *PREFIX_COLUMNS).write.mode("overwrite").partitionBy(*PREFIX_COLUMNS).parquet(path)
