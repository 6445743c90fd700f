"""Records, manifest rows, and how many bytes a record takes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One version of one key. `seq` breaks ties of key and time within a batch.
RECORD = T.StructType(
    [
        T.StructField("key", T.StringType(), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("doc", T.BinaryType(), True),
        T.StructField("tombstone", T.BooleanType(), False),
    ]
)

#: One immutable segment.
BLOB_META = T.StructType(
    [
        T.StructField("blob_id", T.StringType(), False),
        T.StructField("min_key", T.StringType()),
        T.StructField("max_key", T.StringType()),
        T.StructField("min_time", T.TimestampNTZType()),
        T.StructField("max_time", T.TimestampNTZType()),
        T.StructField("count", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("created", T.TimestampNTZType()),
    ]
)

# Fixed values of the record format: file header, then per record.
HEADER_BYTES, PUT_BYTES, NULL_BYTES, TOMBSTONE_BYTES = 6, 37, 32, 12
#: Overhead that a delta's size estimate adds to each record, and the default limit of a delta.
ESTIMATE_BYTES, DELTA_LIMIT = 100, 1 << 30


def record_bytes(key: Column, doc: Column, tombstone: Column) -> Column:
    """Bytes of a record in a segment."""
    body = F.when(doc.isNull(), F.lit(NULL_BYTES)).otherwise(F.octet_length(doc) + PUT_BYTES)
    return (body + F.octet_length(key) + F.when(tombstone, TOMBSTONE_BYTES).otherwise(0)).cast("bigint")


def estimated_bytes(key: Column, doc: Column) -> Column:
    """What a record counts against a delta's limit."""
    return (F.octet_length(key) + F.coalesce(F.octet_length(doc), F.lit(0)) + ESTIMATE_BYTES).cast("bigint")
