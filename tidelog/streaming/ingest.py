"""Ingest: admission to a delta, and a stream of changes appended to it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.schema import DELTA_LIMIT, estimated_bytes
from tidelog.sources import events


def admitted(log: DataFrame, order: str, limit: int = DELTA_LIMIT) -> DataFrame:
    """The records that a delta with room for `limit` estimated bytes takes, in order; a refused one takes no room.

    Whether a record fits depends on which ones before it did. Records are dealt to ranges of the order; a range that fits
    whole is taken whole and one whose smallest record doesn't fit is left out, by sums alone. Only a range in between is
    walked, one at a time, without those that are too large by themselves, so no task sees more than a range.
    """
    sized = log.withColumn("__est", estimated_bytes(F.col("key"), F.col("doc"))).where(F.col("__est") <= limit)
    path = scratch(log.sparkSession, "admission")
    sized.repartitionByRange(order).withColumn("__p", F.spark_partition_id()).write.parquet(path)
    ranges = log.sparkSession.read.schema(T.StructType([*sized.schema.fields, T.StructField("__p", T.IntegerType())])).parquet(path)
    sums = ranges.groupBy("__p").agg(F.sum("__est").alias("n"), F.min("__est").alias("least")).orderBy("__p").collect()  # a row a range
    total, whole, walked = 0, [], []
    for r in sums:
        if total + r["n"] <= limit:
            whole.append(r["__p"])
            total += r["n"]
        elif total + r["least"] <= limit:
            part = _walked(ranges.where(F.col("__p") == r["__p"]), order, limit - total)
            part.write.parquet(f"{path}-{r['__p']}")
            part = log.sparkSession.read.schema(ranges.schema).parquet(f"{path}-{r['__p']}")
            total += part.agg(F.coalesce(F.sum("__est"), F.lit(0))).first()[0]
            walked.append(part)
    out = ranges.where(F.col("__p").isin(whole)) if whole else ranges.limit(0)
    for part in walked:
        out = out.unionByName(part)
    return out.drop("__est", "__p")


def _walked(part: DataFrame, order: str, room: int) -> DataFrame:
    """The records of one range that fit in `room`, by one pass in order."""

    def fold(batches: Iterator) -> Iterator:
        total = 0
        for b in batches:
            keep = []
            for i, n in enumerate(b.column(b.schema.get_field_index("__est")).to_pylist()):
                if total + n <= room:
                    total += n
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    return part.where(F.col("__est") <= room).coalesce(1).sortWithinPartitions(order).mapInArrow(fold, part.schema)


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's name where driver and executors both write."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file:///tmp/checkpoints"
    return f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def ingested(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """The events as a stream of micro-batches appended to a delta table, then read as a log.

    A batch that is retried overwrites its own folder, so each change is in the delta once.
    """
    path = path or scratch(spark, "delta")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def append(batch: DataFrame, epoch: int) -> None:
        events.as_log(batch).write.mode("overwrite").parquet(f"{path}/delta/epoch={epoch}")

    run = source.writeStream.foreachBatch(append).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/delta").drop("epoch")


def stream_into(store, source: DataFrame, progress: str):
    """A streaming query that puts each micro-batch of (key, doc) rows into a store; rows without a doc delete.

    A batch is put before its progress is noted, so after a failure it may be put again: as newer versions with the
    same values, which reads don't tell apart.
    """

    def put(batch: DataFrame, epoch: int) -> None:
        batch = batch.select("key", F.col("doc").cast("binary").alias("doc")).persist()
        puts, deletes = batch.where("doc is not null"), batch.where("doc is null").select("key")
        if puts.take(1):
            store.put_batch(puts)
        if deletes.take(1):
            store.delete_batch(deletes)
        batch.unpersist()

    return source.writeStream.foreachBatch(put).option("checkpointLocation", progress)
