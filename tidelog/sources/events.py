"""The events table seen as a log of versions: one segment a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.scalar import to_millis


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def as_log(events: DataFrame, *extra: str) -> DataFrame:
    """key, ts, doc, tombstone, blob and `extra` columns: errors delete, every third signup puts an empty value."""
    error, empty = F.col("event_type") == "error", (F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0)
    return events.select(
        F.lpad(F.col("user_id").cast("string"), 6, "0").alias("key"),
        to_millis(F.col("ts")).alias("ts"),
        F.when(error, F.lit(None).cast("string")).when(empty, F.lit("")).otherwise(F.col("props")).alias("doc"),
        error.alias("tombstone"),
        F.date_format("ts", "yyyy-MM-dd").alias("blob"),
        *extra,
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_log(read(spark, sf_dir))
