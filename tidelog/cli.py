"""Command line: init, put, get, delete, scan, flush, compact on a store.

    python -m tidelog.cli --store file:///data/store put < documents.jsonl
"""

from __future__ import annotations

import argparse
import json
import math
import os
import sys

from tidelog.errors import NoRecords, NotFound
from tidelog.functions.scalar import number_text, parse_time
from tidelog.operators.compact import ORDERS
from tidelog.operators.compact import Options as CompactOptions
from tidelog.sources.store import Options, Store


def id_text(value) -> str:
    """A document's _id as a key: numbers as the shortest decimal text, the rest as it is."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return number_text(float(value)) if math.isfinite(float(value)) else str(value)
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))


def documents(stream, size: int = 1 << 20):
    """The JSON objects that follow one another in a stream, which is read in parts."""
    decoder, rest, more = json.JSONDecoder(), "", True
    while more or rest:
        part = stream.read(size) if more else ""
        more, rest = bool(part), (rest + part).lstrip()
        at = 0
        while at < len(rest):
            try:
                value, end = decoder.raw_decode(rest, at)
            except json.JSONDecodeError:
                if not more:
                    raise
                break  # the rest of it is still to come
            if more and end == len(rest) and not isinstance(value, (dict, list, str)):
                break  # a number may go on
            yield value
            at = end
            while at < len(rest) and rest[at].isspace():
                at += 1
        rest = rest[at:]


def batches(docs, most: int = 10_000, size: int = 16 << 20):
    """Lists of (key, document, place), each of `most` documents or `size` bytes about; a document without _id is an error."""
    rows, held = [], 0
    for i, doc in enumerate(docs):
        if not isinstance(doc, dict) or "_id" not in doc:
            raise ValueError(f"document {i} has no _id")
        rows.append((id_text(doc["_id"]), bytearray(json.dumps(doc, sort_keys=True).encode()), i))
        held += len(rows[-1][1])
        if len(rows) >= most or held >= size:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelog")
    p.add_argument("--store", default=os.environ.get("TIDELOG_STORE"), help="folder of the store, a URI that Spark can write")
    p.add_argument("--index-every", type=int, default=32)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "put", "flush"):
        sub.add_parser(name)
    for name in ("get", "delete"):
        sub.add_parser(name).add_argument("key")
    scan = sub.add_parser("scan")
    for name in ("--start", "--end"):
        scan.add_argument(name, default="")
    scan.add_argument("--prefix")
    c = sub.add_parser("compact")
    c.add_argument("--order", choices=list(ORDERS), default="oldest")
    for name, default in (("--min-files", 2), ("--max-files", 0), ("--min-size", 0), ("--max-size", 0)):
        c.add_argument(name, type=int, default=default)
    for name in ("--min-time", "--max-time"):
        c.add_argument(name, type=parse_time)
    return p


def main(argv: list[str] | None = None, spark=None, stdin=None, out=None) -> int:
    args = parser().parse_args(argv)
    stdin, out = stdin or sys.stdin, out or sys.stdout
    if not args.store:
        print("--store or TIDELOG_STORE is needed", file=sys.stderr)
        return 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tidelog").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    options = Options(index_every=args.index_every)
    if args.command == "init":
        Store.init(spark, args.store, options)
        return 0
    store = Store(spark, args.store, options)
    if args.command == "put":
        n, to = 0, ""
        try:
            for rows in batches(documents(stdin)):
                stats = store.put_batch(spark.createDataFrame(rows, "key string, doc binary, i long"), order="i")
                n, to = n + stats.records, stats.destination
        except ValueError as e:
            print(f"{e}; {n} documents were put before", file=sys.stderr)
            return 1
        if n:
            print(f"put {n} documents into {to}", file=out)
    elif args.command == "get":
        try:
            value, stats = store.get(args.key)
        except NotFound as e:
            print(f"not found: {e.key}", file=sys.stderr)
            return 1
        print(value.decode(errors="replace"), file=out)
        print(stats, file=sys.stderr)
    elif args.command == "delete":
        store.delete(args.key)
    elif args.command == "scan":
        for row in store.scan(args.start, args.end, args.prefix).rows.toLocalIterator():
            print(f"{row['key']}\t{bytes(row['doc']).decode(errors='replace')}", file=out)
    elif args.command == "flush":
        try:
            stats = store.flush()
        except NoRecords:
            print("nothing to flush", file=sys.stderr)
            return 1
        for b in stats.blobs:
            print(f"flushed {b['count']} records to {b['blob_id']}; active: {stats.active}", file=out)
    elif args.command == "compact":
        stats = store.compact(CompactOptions(args.order, args.min_files, args.max_files, args.min_size, args.max_size, args.min_time, args.max_time))
        if stats.error:
            print(f"failed: {stats.error}", file=sys.stderr)
            return 1
        print(f"compacted {len(stats.inputs)} segments into {len(stats.outputs)}", file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
