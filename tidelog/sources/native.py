"""The row-oriented segment format as a Spark data source, to bring old segments in and to hand new ones out.

A file is a six-byte header and then records, each a BSON document with key, ts, doc and, if true, tombstone. What the
header says is for the option `magic` to check; without it any header will do. Python decodes, as no BSON library is
at hand; the engine's own segments are Parquet.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidelog.schema import HEADER_BYTES

EPOCH = datetime(1970, 1, 1)
SCHEMA = "key string, ts timestamp_ntz, doc binary, tombstone boolean"


def encode(key: str, ts: datetime, doc: bytes | None, tombstone: bool = False) -> bytes:
    """One record."""
    k = key.encode()
    body = b"\x02key\x00" + struct.pack("<i", len(k) + 1) + k + b"\x00"
    body += b"\x09ts\x00" + struct.pack("<q", (ts - EPOCH) // timedelta(milliseconds=1))
    body += b"\x0adoc\x00" if doc is None else b"\x05doc\x00" + struct.pack("<i", len(doc)) + b"\x00" + bytes(doc)
    if tombstone:
        body += b"\x08tombstone\x00\x01"
    return struct.pack("<i", len(body) + 5) + body + b"\x00"


def decode(raw: bytes) -> tuple[str, datetime, bytes | None, bool]:
    """A record's four fields, whatever their order; unknown fields are an error."""
    found: dict = {"doc": None, "tombstone": False}
    at = 4
    while raw[at]:
        kind, end = raw[at], raw.index(0, at + 1)
        name, at = raw[at + 1 : end].decode(), end + 1
        if kind == 2:
            (n,) = struct.unpack_from("<i", raw, at)
            found[name], at = raw[at + 4 : at + 3 + n].decode(), at + 4 + n
        elif kind == 9:
            found[name], at = EPOCH + timedelta(milliseconds=struct.unpack_from("<q", raw, at)[0]), at + 8
        elif kind == 5:
            (n,) = struct.unpack_from("<i", raw, at)
            found[name], at = raw[at + 5 : at + 5 + n], at + 5 + n
        elif kind == 10:
            found[name] = None
        elif kind == 8:
            found[name], at = bool(raw[at]), at + 1
        else:
            raise ValueError(f"field {name!r} has type {kind}")
    return found["key"], found["ts"], found["doc"], found["tombstone"]


def records(stream) -> Iterator[tuple]:
    """The records from here to the end of a stream."""
    while head := stream.read(4):
        if len(head) < 4 or (n := struct.unpack("<i", head)[0]) < 5:
            raise ValueError("a record's length is wrong")
        rest = stream.read(n - 4)
        if len(rest) < n - 4:
            raise ValueError("the file ends within a record")
        yield decode(head + rest)


def _listed(path: str):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    info = store.get_file_info(root)
    files = [root] if info.is_file else sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.is_file)
    return store, files


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segment"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


class _Reader(DataSourceReader):
    """A partition a file; options start and end bound keys, and reading stops at the end, as files are sorted."""

    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _listed(self.options["path"])[1]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = _listed(self.options["path"])
        start, end = self.options.get("start", "").encode(), self.options.get("end", "").encode()
        with store.open_input_stream(partition.value) as stream:
            head = stream.read(HEADER_BYTES)
            if len(head) < HEADER_BYTES or head != self.options.get("magic", head.decode("latin-1")).encode("latin-1"):
                raise ValueError(f"{partition.value} has a wrong header")
            for key, ts, doc, tombstone in records(stream):
                k = key.encode()
                if end and k >= end:
                    return
                if k >= start:
                    yield key, ts, doc, tombstone


class _Writer(DataSourceWriter):
    """A file a partition, whose rows must come sorted; empty partitions write none."""

    def __init__(self, options: dict) -> None:
        self.options = options
        if len(options.get("magic", "").encode("latin-1")) != HEADER_BYTES:
            raise ValueError(f"option magic must have {HEADER_BYTES} characters")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(self.options["path"])
        first = next(rows, None)
        if first is not None:
            store.create_dir(root, recursive=True)
            draft = f"{root}/.part-{task.partitionId():05d}-{task.taskAttemptId()}"
            with store.open_output_stream(draft) as out:
                out.write(self.options["magic"].encode("latin-1"))
                while first is not None:
                    out.write(encode(first["key"], first["ts"], first["doc"], first["tombstone"]))
                    first = next(rows, None)
            store.move(draft, f"{root}/part-{task.partitionId():05d}")
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        return None

    def abort(self, messages) -> None:
        return None


def register(spark) -> None:
    spark.dataSource.register(SegmentSource)
