"""Compaction: choosing segments, merging them, and dropping versions that retention gives up."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.operators import meta as M

ORDERS = {
    "oldest": ("created", True),
    "newest": ("created", False),
    "smallest": ("size", True),
    "largest": ("size", False),
}


@dataclass(frozen=True)
class GCPolicy:
    """What to drop; zero leaves a rule out. Ages are exclusive: a record just as old as the limit stays."""

    max_versions: int = 0
    max_age: timedelta = timedelta(0)
    tombstone_age: timedelta = timedelta(0)

    def __post_init__(self) -> None:
        if self.max_versions < 0 or self.max_age < timedelta(0) or self.tombstone_age < timedelta(0):
            raise ValueError("retention limits can't be negative")


@dataclass(frozen=True)
class Options:
    """Which segments to compact. Zero or None leaves a limit out."""

    order: str = "oldest"
    min_files: int = 0
    max_files: int = 0
    min_size: int = 0
    max_size: int = 0
    min_time: datetime | None = None
    max_time: datetime | None = None
    gc: GCPolicy = field(default_factory=GCPolicy)

    def __post_init__(self) -> None:
        if self.order not in ORDERS:
            raise ValueError(f"no order {self.order!r}")
        if min(self.min_files, self.max_files, self.min_size, self.max_size) < 0:
            raise ValueError("limits can't be negative")


def ordering(order: str, tie: str = "blob") -> list[Column]:
    column, ascending = ORDERS[order]
    return [F.col(column).asc() if ascending else F.col(column).desc(), F.col(tie).asc()]


def select(meta: DataFrame, options: Options, tie: str = "blob") -> DataFrame:
    """`meta` rows to compact, with `ord`, their place from 1; no rows if the minimum isn't met.

    Files are taken in order. One that would push the sum above max_size is passed over and the search goes on; at
    max_files it ends. With a size limit that is one pass over the sorted manifest, which has one entry a segment.
    """
    asked = M.pruned_by_time(meta, options.min_time, options.max_time)
    place = F.row_number().over(Window.orderBy(*ordering(options.order, tie))).cast("bigint")
    placed = asked.withColumn("ord", place)
    if options.max_size:
        most = options.max_files or float("inf")

        def fold(batches):
            total = taken = 0
            for b in batches:
                kept, ords = [], []
                for i, size in enumerate(b.column(b.schema.get_field_index("size")).to_pylist()):
                    if taken < most and total + size <= options.max_size:
                        total, taken = total + size, taken + 1
                        kept.append(i)
                        ords.append(taken)
                b = b.take(pa.array(kept, pa.int64()))
                yield b.set_column(b.schema.get_field_index("ord"), "ord", pa.array(ords, pa.int64()))

        placed = placed.coalesce(1).sortWithinPartitions("ord").mapInArrow(fold, placed.schema)
    elif options.max_files:
        placed = placed.where(F.col("ord") <= options.max_files)
    if options.min_files or options.min_size:
        whole = Window.partitionBy()
        placed = placed.withColumns({"__n": F.count("*").over(whole), "__s": F.sum("size").over(whole)})
        placed = placed.where((F.col("__n") >= options.min_files) & (F.col("__s") >= options.min_size)).drop("__n", "__s")
    return placed


def collect_garbage(log: DataFrame, policy: GCPolicy, now: datetime) -> DataFrame:
    """Versions that stay: not too old, not an old tombstone, and then among the newest of their key.

    A dropped tombstone no longer hides older versions, and takes no place among the newest.
    """
    if policy.max_age:
        log = log.where(F.col("ts") >= F.lit(now - policy.max_age))
    if policy.tombstone_age:
        log = log.where(~(F.col("tombstone") & (F.col("ts") < F.lit(now - policy.tombstone_age))))
    if policy.max_versions:
        ties = [F.desc(c) for c in ("created", "blob_id", "seq") if c in log.columns]
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts"), *ties))
        log = log.withColumn("__v", place).where(F.col("__v") <= policy.max_versions).drop("__v")
    return log
