"""Reads: the newest version of each key wins, and only then are deleted and empty ones left out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions.scalar import in_range, place_in
from tidelog.schema import HEADER_BYTES, record_bytes

#: Orders versions of a key where the log has these columns: time, then what makes the order total.
TIES = ("created", "blob_id", "seq")


def recency(log: DataFrame, first: Sequence[str] = ()) -> Column:
    return F.struct(*first, "ts", *[c for c in TIES if c in log.columns])


#: Keys that are asked for at once by an array that goes to every task; more are joined instead.
ASKED_KEYS = 100_000


def asked_array(keys: DataFrame) -> DataFrame | None:
    """One row with `asked`, the distinct keys ascending, or nothing where they are too many for one."""
    distinct = keys.select("key").where("key is not null").distinct()
    if distinct.limit(ASKED_KEYS + 1).count() > ASKED_KEYS:
        return None
    return distinct.agg(F.array_sort(F.collect_list("key")).alias("asked"))


def newest(log: DataFrame, first: Sequence[str] = ()) -> DataFrame:
    """One row a key, its newest version. `first`: columns that rank above time.

    An aggregate, so versions are combined before the shuffle and a hot key sends one row from each task.
    """
    rest = [c for c in log.columns if c != "key"]
    won = log.groupBy("key").agg(F.max_by(F.struct(*rest), recency(log, first)).alias("v"))
    return won.select("key", *[F.col(f"v.{c}").alias(c) for c in rest])


def live_by_flag(newest_rows: DataFrame) -> DataFrame:
    """What Get sees: not deleted, empty values included."""
    return newest_rows.where(~F.col("tombstone"))


def live_by_value(newest_rows: DataFrame) -> DataFrame:
    """What Scan sees: a value that isn't empty."""
    return newest_rows.where(F.octet_length("doc") > 0)


def scan(log: DataFrame, start: str = "", end: str = "", prefix: str | None = None) -> DataFrame:
    """key, doc, ts of live keys in [start, end) or under a prefix, by key. Bounds reach the source; liveness doesn't."""
    asked = log.where(in_range(F.col("key"), start, end))
    if prefix is not None:
        asked = asked.where(F.col("key").startswith(prefix))
    return live_by_value(newest(asked)).select("key", "doc", "ts").orderBy("key")


def get(log: DataFrame, key: str, *, memtable_first: bool = False) -> DataFrame:
    """The live version of one key, one row or none; empty values count as live."""
    first = ["is_memtable", "memtable_created"] if memtable_first else []
    first = [c for c in first if c in log.columns]
    return live_by_flag(newest(log.where(F.col("key") == key), first))


def get_batch(log: DataFrame, keys: DataFrame, *, first: Sequence[str] = ()) -> DataFrame:
    """key, doc, ts, found for each distinct asked key."""
    asked = keys.select("key").distinct()
    hit = live_by_flag(newest(log.join(asked, "key", "left_semi"), first)).select("key", "doc", "ts", F.lit(True).alias("hit"))
    return asked.join(hit, "key", "left").select("key", "doc", "ts", F.coalesce("hit", F.lit(False)).alias("found"))


def merge_versions(*logs: DataFrame) -> DataFrame:
    """All versions of all sources by key, newest first."""
    out = logs[0]
    for more in logs[1:]:
        out = out.unionByName(more)
    return out.orderBy("key", F.desc("ts"))


def as_of(log: DataFrame, ts) -> DataFrame:
    """The log as it stood at a time."""
    return log.where(F.col("ts") <= F.lit(ts))


def positions(log: DataFrame, blob: str = "blob") -> DataFrame:
    """`log` with rn, a record's place in its segment from 1, bytes, and offset, where it begins."""
    place = Window.partitionBy(blob).orderBy("key", F.desc("ts"))
    size = record_bytes(F.col("key"), F.col("doc"), F.col("tombstone"))
    before = F.sum("bytes").over(place.rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("bytes", size).withColumns({"rn": F.row_number().over(place).cast("bigint"), "offset": (F.coalesce(before, F.lit(0)) + HEADER_BYTES).cast("bigint")})


def get_stats(log: DataFrame, keys: DataFrame, every: int = 8) -> DataFrame:
    """key, blobs_fetched, blobs_skipped, records_scanned of a point read that visits each segment whose key range holds the key.

    A segment without the key is skipped by its filter. In the others reading begins at the last index entry below the
    key and ends at the key's first record. All records before that one are below the key, so how many these are tells
    which entry that is: records are counted, never sorted one by one.

    No row is made for a key and a segment without it: the segments whose range holds a key are those that begin at it
    or below, less those that end below it, and both are places in the sorted bounds of all segments (under 2**20).
    """
    asked = keys.select("key").where("key is not null").distinct()
    array = asked_array(keys)
    held = log.where("blob is not null and key is not null").select("blob", "key")
    found = _counted(held, array) if array is not None else _ranked(held)
    entry = F.when(F.col("at") > 1, F.floor((F.col("at") - 2) / every) * every + 1).otherwise(1)
    cost = found.groupBy("key").agg(F.count("*").alias("fetched"), F.sum(F.col("at") - entry + 1).alias("scanned"))
    zones = log.groupBy("blob").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    zones = zones.agg(F.array_sort(F.collect_list("lo")).alias("los"), F.array_sort(F.collect_list("hi")).alias("his"))
    inside = place_in(F.col("key"), F.col("los")) - place_in(F.col("key"), F.col("his"), below=True)
    asked = asked.crossJoin(F.broadcast(zones)).select("key", inside.cast("bigint").alias("inside")).where("inside > 0")  # one row
    fetched = F.coalesce("fetched", F.lit(0))
    return asked.join(cost, "key", "left").select(
        "key",
        fetched.cast("bigint").alias("blobs_fetched"),
        (F.col("inside") - fetched).cast("bigint").alias("blobs_skipped"),
        F.coalesce("scanned", F.lit(0)).cast("bigint").alias("records_scanned"),
    )


def scanned_totals(stats: DataFrame) -> DataFrame:
    """What point reads cost in all: keys, and the sum, largest and mean of their records scanned. stats: rows of get_stats()."""
    n = F.col("records_scanned")
    return stats.agg(F.count("*").alias("keys"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("total_scanned"), F.max(n).alias("max_scanned"), F.avg(n).alias("mean_scanned"))


def _counted(held: DataFrame, array: DataFrame) -> DataFrame:
    """key, at: the place of an asked key's first record in each segment that has it. Tasks send a row a segment and gap between asked keys."""
    # Both places come from one projection: a later one would be handed the array with each row.
    p, below = (place_in(F.col("key"), F.col("asked"), below=b) for b in (False, True))
    placed = held.crossJoin(F.broadcast(array)).select("blob", "key", p.alias("p"), below.alias("below"))  # one row
    hit = F.col("p") > F.col("below")
    # `hit` tells that the gap's key is there; its records are the gap's first.
    gaps = placed.groupBy("blob", "p").agg(F.count("*").alias("n"), F.max(hit).alias("hit"), F.min("key").alias("key"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("blob").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return gaps.withColumn("at", before + 1).where("hit").select("key", "at")


#: Distinct keys, about, between two bounds of ranges.
RANGE_KEYS = 10_000


def _ranked(held: DataFrame) -> DataFrame:
    """key, at: the place of each key's first record in each segment that has it, whether asked for or not.

    Tasks send a row for each segment and key. These are summed up within ranges of keys, so that no segment comes to
    one task, and a range's own start is the sum of a segment's ranges before it.
    """
    n_keys = held.agg(F.approx_count_distinct("key")).first()[0]
    # Keys whose hash is low bound the ranges; which these are changes no result.
    low = F.pmod(F.xxhash64("key"), F.lit(RANGE_KEYS)) == 0
    bounds = held.where(low).distinct().agg(F.array_sort(F.collect_set("key")).alias("bounds")) if n_keys > RANGE_KEYS else None
    counts = held.groupBy("blob", "key").agg(F.count("*").alias("n"))
    if bounds is None:
        counts = counts.withColumn("b", F.lit(0))
    else:
        counts = counts.crossJoin(F.broadcast(bounds)).select("blob", "key", "n", place_in(F.col("key"), F.col("bounds")).alias("b"))  # one row
    up = Window.unboundedPreceding, -1
    starts = counts.groupBy("blob", "b").agg(F.sum("n").alias("s"))
    starts = starts.select("blob", "b", F.coalesce(F.sum("s").over(Window.partitionBy("blob").orderBy("b").rowsBetween(*up)), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("n").over(Window.partitionBy("blob", "b").orderBy("key").rowsBetween(*up)), F.lit(0))
    return counts.withColumn("within", within).join(starts, ["blob", "b"]).select("key", (F.col("start") + F.col("within") + 1).alias("at"))


def scan_stats(log: DataFrame, is_memtable: Column, start: str = "", end: str = "") -> DataFrame:
    """records_returned, memtables_read, sstables_read of a scan; segments outside the range aren't read."""
    returned = scan(log, start, end).agg(F.count("*").alias("records_returned"))
    zone = log.withColumn("m", is_memtable).groupBy("blob", "m").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    meets = F.lit(True)
    if start:
        meets = meets & (F.col("hi") >= start)
    if end:
        meets = meets & (F.col("lo") < end)
    read = zone.agg(F.count_if(F.col("m")).alias("memtables_read"), F.count_if(~F.col("m") & meets).alias("sstables_read"))
    return returned.crossJoin(read)  # one row each
