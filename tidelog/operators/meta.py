"""Segment metadata: zone maps, the lookups over them, and atomic replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.errors import Conflict
from tidelog.schema import HEADER_BYTES, record_bytes


def blob_meta(log: DataFrame, blob: str = "blob") -> DataFrame:
    """One row a segment: key and time range, versions (tombstones included), bytes."""
    size = record_bytes(F.col("key"), F.col("doc"), F.col("tombstone"))
    return log.groupBy(blob).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.min("ts").alias("min_time"), F.max("ts").alias("max_time"),
        F.count("*").alias("count"), (F.sum(size) + HEADER_BYTES).cast("bigint").alias("size"),
    )


def ordinal(*order: Column) -> Column:
    """A place from 1 in the manifest, which has one row a segment."""
    return F.row_number().over(Window.orderBy(*order)).cast("bigint")


def containing(meta: DataFrame, key: str) -> DataFrame:
    """Segments whose closed key range holds the key, newest first."""
    hit = meta.where((F.col("min_key") <= key) & (F.col("max_key") >= key))
    return hit.withColumn("ord", ordinal(F.desc("max_time"), F.desc("created")))


def all_by_key(meta: DataFrame) -> DataFrame:
    """All segments by first key, newest first among equals."""
    return meta.withColumn("ord", ordinal(F.asc("min_key"), F.desc("max_time")))


def pruned_by_key(meta: DataFrame, start: str = "", end: str = "") -> DataFrame:
    """Segments that a range [start, end) can meet."""
    if end:
        meta = meta.where(F.col("min_key") < end)
    if start:
        meta = meta.where(F.col("max_key") >= start)
    return meta


def pruned_by_time(meta: DataFrame, min_time=None, max_time=None) -> DataFrame:
    """Segments that meet the closed time range; records outside it stay in those."""
    if min_time is not None:
        meta = meta.where(F.col("max_time") >= F.lit(min_time))
    if max_time is not None:
        meta = meta.where(F.col("min_time") <= F.lit(max_time))
    return meta


def swapped(meta: DataFrame, inputs: DataFrame, outputs: DataFrame, on: str = "blob", *, check: bool = False) -> DataFrame:
    """The manifest without `inputs` and with `outputs`. check: fail unless every input is there."""
    if check and inputs.join(meta, on, "left_anti").take(1):
        raise Conflict("a segment to be replaced is not in the manifest")
    return meta.join(inputs.select(on), on, "left_anti").unionByName(outputs)
