"""The two logs, read off the `events` test table: purchases are trades, all else logins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Its schema is read off the files once, not at every call."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type") != "purchase")
    code = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return events.select(
        F.col("event_id").alias("log_id"),
        F.round(F.col("value") * 100).cast("long").alias("timelong"),
        (code % 5).alias("device"),
        F.col("event_type").alias("log_from"),
        code.alias("ip"),
        (code % 7).alias("city"),
        F.when(F.col("event_type") == "error", 31).otherwise(1).alias("result"),
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', ts)").alias("timestamp"),
        (code % 3).alias("type"),
        F.col("user_id").alias("id"),
        (code % 2 == 0).alias("is_scan"),
        (code % 4 == 0).alias("is_sec"),
        F.col("ts").alias("time"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return events.select(
        F.col("event_id").alias("rowkey"),
        F.col("ts").alias("time"),
        F.col("user_id").alias("id"),
        F.when(F.col("value") > 100, 1).otherwise(0).alias("is_risk"),
    )


def test_part(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key) % 5 == 0)


def train_part(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key) % 5 != 0)
