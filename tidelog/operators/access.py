"""Access paths within segments: sparse indexes and membership filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.errors import NoRecords
from tidelog.operators.read import asked_array, positions


def index_every_records(log: DataFrame, every: int, blob: str = "blob") -> DataFrame:
    """An entry before record 1, every + 1, ... of each segment."""
    return positions(log, blob).where((F.col("rn") - 1) % every == 0).select(blob, "key", "offset")


def index_every_bytes(log: DataFrame, every: int, blob: str = "blob") -> DataFrame:
    """An entry before the first record, and before each record that has `every` bytes or more since the last entry.

    The count restarts at each entry, which no window frame does, so each segment is walked once, by jumps over its
    running sum. A segment's rows come to one task, as its records do when it is written, in sorted batches, of which one
    at a time is held.
    """
    placed = positions(log, blob).select(blob, "key", "offset")
    schema = placed.schema

    def walk(batches):
        import numpy as np

        last, entry = None, 0
        for b in batches:
            offsets, names = b.column(2).to_numpy(), np.array(b.column(0).to_pylist(), object)
            starts = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.zeros(0, int)
            taken = []
            for i, end in zip(starts, np.append(starts[1:], len(names)), strict=True):
                if names[i] == last:  # the segment goes on from the batch before
                    i += int(np.searchsorted(offsets[i:end], entry + every))
                while i < end:
                    taken.append(i)
                    entry = int(offsets[i])
                    i += int(np.searchsorted(offsets[i:end], entry + every))
                last = names[end - 1]
            yield b.take(pa.array(taken, pa.int64()))

    import pyarrow as pa

    return placed.repartition(blob).sortWithinPartitions(blob, "offset").mapInArrow(walk, schema)


def lookup(index: DataFrame, keys: DataFrame, blob: str = "blob") -> DataFrame:
    """blob, key, first, last: the byte range to read for each key; last is 0 for the end of the file.

    Reading starts at the last entry below the key, or at the first entry, and ends before the first entry above it. A
    key below a segment's first entry has no range there.

    Asked keys take their places among the entries of each segment that they aren't below, and one pass up and one down
    give their neighbours: what is sorted is the index and what comes out, not their product.
    """
    entries = index.groupBy(blob, "key").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi"))
    zones = index.groupBy(blob).agg(F.min("key").alias("least"), F.min("offset").alias("begin"))
    array = asked_array(keys)
    if array is not None:
        from_least = F.expr("slice(asked, p + 1, size(asked))")
        below = F.filter("asked", lambda k: k < F.col("least"))
        asked = zones.crossJoin(F.broadcast(array)).withColumn("p", F.size(below)).select(blob, F.explode(from_least).alias("key"))  # one row
    else:
        asked = zones.join(keys.select("key").distinct(), F.col("least") <= F.col("key")).select(blob, "key")
    none = F.lit(None).cast("bigint")
    both = entries.select(blob, "key", "lo", "hi", F.lit(0).alias("asked")).unionByName(asked.select(blob, "key", none.alias("lo"), none.alias("hi"), F.lit(1).alias("asked")))
    both = both.groupBy(blob, "key").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("asked").alias("asked"))
    up, down = Window.partitionBy(blob).orderBy("key"), Window.partitionBy(blob).orderBy(F.desc("key"))
    before = F.last("hi", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("lo", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    found = both.withColumns({"b": before, "a": after}).where("asked = 1")
    # A key that equals the first entry has none below it: reading starts at that one.
    return found.select(blob, "key", F.coalesce("b", "lo").cast("bigint").alias("first"), F.coalesce(F.col("a") - 1, F.lit(0)).cast("bigint").alias("last"))


def filter_keys(log: DataFrame, blob: str = "blob") -> DataFrame:
    """The distinct keys of each segment: the exact form of its filter."""
    return log.select(blob, "key").distinct()


def filter_skips(log: DataFrame, meta: DataFrame, keys: DataFrame, blob: str = "blob") -> DataFrame:
    """(blob, key) pairs whose key lies in the segment's range, but not in the segment."""
    asked, array = keys.select("key").distinct(), asked_array(keys)
    if array is not None:
        inside = meta.crossJoin(F.broadcast(array)).select(blob, F.explode(F.filter("asked", lambda k: k.between(F.col("min_key"), F.col("max_key")))).alias("key"))  # one row
    else:
        inside = asked.join(meta, F.col("key").between(F.col("min_key"), F.col("max_key"))).select(blob, "key")
    held = filter_keys(log.join(asked, "key", "left_semi"), blob)
    return inside.join(held, [blob, "key"], "left_anti")


#: Bits a key and hash functions of a filter: about four false answers in a thousand.
BITS_PER_KEY, HASHES = 12, 8


def _positions(hashes, size: int):
    """Where a key's bits are: two halves of one hash, combined HASHES times."""
    import numpy as np

    h = np.asarray(hashes, np.int64).view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(k) * high + np.uint64(k * k)) % np.uint64(size)).astype(np.int64) for k in range(HASHES)]


def _filter_bytes(hashes) -> bytes:
    import numpy as np

    hashes = np.unique(hashes)
    size = max(64, -(-len(hashes) * BITS_PER_KEY // 64) * 64)
    bits = np.zeros(size, bool)
    for at in _positions(hashes, size):
        bits[at] = True
    return np.packbits(bits).tobytes()


def filters(log: DataFrame, blob: str = "blob") -> DataFrame:
    """blob, data: the filter of each segment, all in one job; a task holds 8 bytes for each key of a segment."""

    def build(table):
        import pyarrow as pa

        return pa.table({blob: pa.array([table.column(0)[0].as_py()]), "data": pa.array([_filter_bytes(table.column(1).to_numpy())], pa.binary())})

    return log.select(blob, F.xxhash64("key").alias("h")).distinct().groupBy(blob).applyInArrow(build, f"`{blob}` string, data binary")


class Membership:
    """A Bloom filter over a segment's keys; it never denies a key that is there."""

    def __init__(self, data: bytes) -> None:
        import numpy as np

        if not data:
            raise ValueError("an empty filter")
        self.data, self._bits = data, np.frombuffer(data, np.uint8)

    @classmethod
    def build(cls, keys: DataFrame) -> Membership:
        found = filters(keys.select(F.lit("").alias("blob"), "key")).first()
        if found is None:
            raise NoRecords("a filter needs keys")
        return cls(bytes(found["data"]))

    def contains(self, key: str) -> bool:
        import xxhash

        h = xxhash.xxh64_intdigest(key.encode(), 42)  # what xxhash64 of a string is
        at = [int(p[0]) for p in _positions([h - (1 << 64) if h >> 63 else h], 8 * len(self._bits))]
        return all(self._bits[p >> 3] >> (7 - (p & 7)) & 1 for p in at)

    def to_bytes(self) -> bytes:
        return self.data

    @classmethod
    def from_bytes(cls, raw: bytes) -> Membership:
        return cls(raw)


def contains(keys: DataFrame, probe: Column) -> DataFrame:
    """Rows of `keys` that hold the probe."""
    return keys.where(F.col("key") == probe)
