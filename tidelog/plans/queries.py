"""The engine's operators as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.functions.scalar import increment_prefix, json_key, segment_name
from tidelog.operators import access, compact, read
from tidelog.operators import meta as M
from tidelog.schema import estimated_bytes
from tidelog.sources import events
from tidelog.sources.store import Store
from tidelog.streaming import ingest

HELD_BACK, LAST, FIRST = "2024-01-15", "2024-01-30", "2024-01-01"
NOW = datetime(2024, 1, 31)
PROBES = ("000007", "000042", "000111")


def _keys(spark: SparkSession, keys) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key string")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of the day segments, each created a day later."""
    meta = M.blob_meta(events.log(spark, sf_dir))
    return meta.withColumn("created", F.date_add(F.col("blob").cast("date"), 1).cast("timestamp_ntz"))


def scan_full(spark, d):
    return read.scan(events.log(spark, d))


def scan_range(spark, d):
    return read.scan(events.log(spark, d), "000010", "000050")


def scan_start_only(spark, d):
    return read.scan(events.log(spark, d), start="000090")


def scan_end_only(spark, d):
    return read.scan(events.log(spark, d), end="000030")


def scan_empty_range(spark, d):
    return read.scan(events.log(spark, d), "000010", "000010")


def scan_prefix(spark, d):
    return read.scan(events.log(spark, d), prefix="00001")


def scan_pruned_blobs(spark, d):
    log = events.log(spark, d).withColumn("blob", F.substring("key", 1, 5))
    return M.pruned_by_key(M.blob_meta(log), "000025", "000061").select("blob", "min_key", "max_key", "count", "size")


def scan_stats(spark, d):
    return read.scan_stats(events.log(spark, d), F.col("blob") == F.lit(LAST), "000010", "000050")


def get_point(spark, d):
    return read.get(events.log(spark, d), "000007").select("key", "doc", "ts")


def get_batch(spark, d):
    asked = spark.read.parquet(f"{d}/customer.parquet").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("key"))
    return read.get_batch(events.log(spark, d), asked)


def get_memtable_first(spark, d):
    log = events.log(spark, d).withColumn("is_memtable", F.col("blob") == F.lit(HELD_BACK))
    return read.live_by_flag(read.newest(log, ["is_memtable"])).select("key", "doc", "ts")


def get_empty_value_visible(spark, d):
    return read.live_by_flag(read.newest(events.log(spark, d))).select("key", "doc", "ts")


def get_deleted_keys(spark, d):
    return read.newest(events.log(spark, d)).where("tombstone").select("key", "ts")


def get_stats(spark, d):
    return read.get_stats(events.log(spark, d), _keys(spark, PROBES))


def get_stats_totals(spark, d):
    asked = spark.read.parquet(f"{d}/customer.parquet").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("key"))
    return read.scanned_totals(read.get_stats(events.log(spark, d), asked))


def merge_all_versions(spark, d):
    log = events.log(spark, d)
    days = [log.where(F.col("blob") == day) for day in (FIRST, "2024-01-05", "2024-01-10")]
    place = Window.partitionBy("key").orderBy(F.desc("ts"))
    merged = read.merge_versions(*days)
    return merged.select("key", "ts", "doc", "tombstone", F.row_number().over(place).cast("bigint").alias("version"))


def blob_meta(spark, d):
    return M.blob_meta(events.log(spark, d))


def meta_containing(spark, d):
    return M.containing(_files(spark, d), "000003").select("blob", "ord")


def meta_all(spark, d):
    return M.all_by_key(_files(spark, d)).select("blob", "min_key", "ord")


def index_every_n(spark, d):
    return access.index_every_records(events.log(spark, d), 8)


def index_every_bytes(spark, d):
    return access.index_every_bytes(events.log(spark, d), 256)


def index_lookup(spark, d):
    return access.lookup(access.index_every_records(events.log(spark, d), 8), _keys(spark, PROBES))


def filter_keys(spark, d):
    return access.filter_keys(events.log(spark, d))


def filter_skip(spark, d):
    log = events.log(spark, d)
    return access.filter_skips(log, M.blob_meta(log), _keys(spark, (*PROBES, "000500")))


def _selected(order: str, **limits) -> Callable:
    def query(spark, d):
        return compact.select(_files(spark, d), compact.Options(order=order, **limits)).select("ord", "blob", "size")

    return query


def compact_select_max_size(spark, d):
    small = _selected("smallest", max_size=60_000)(spark, d).withColumn("ordering", F.lit("smallest"))
    return small.unionByName(_selected("newest", max_size=60_000)(spark, d).withColumn("ordering", F.lit("newest")))


def _chosen(spark, d) -> DataFrame:
    files = compact.select(_files(spark, d), compact.Options(order="oldest", max_files=5)).select("blob")
    return events.log(spark, d).join(F.broadcast(files), "blob", "left_semi")


def compact_output_meta(spark, d):
    return M.blob_meta(_chosen(spark, d).withColumn("blob", F.lit("merged")))


def _collected(**rules) -> Callable:
    def query(spark, d):
        return compact.collect_garbage(events.log(spark, d), compact.GCPolicy(**rules), NOW).select("key", "ts", "doc", "tombstone")

    return query


def gc_resurrection(spark, d):
    kept = compact.collect_garbage(events.log(spark, d), compact.GCPolicy(tombstone_age=timedelta(microseconds=1)), NOW)
    return read.scan(kept)


def atomic_swap(spark, d):
    files = _files(spark, d)
    gone = compact.select(files, compact.Options(order="oldest", max_files=5))
    new = compact_output_meta(spark, d).withColumn("blob", F.lit("2024-02-01")).withColumn("created", F.lit(datetime(2024, 2, 1)))
    return M.swapped(files, gone, new.select(*files.columns))


def memtable_size(spark, d):
    return events.log(spark, d).where(F.col("blob") == F.lit(FIRST)).agg(F.sum(estimated_bytes(F.col("key"), F.col("doc"))).alias("bytes"), F.count("*").alias("records"))


def memtable_admission(spark, d):
    log = events.as_log(events.read(spark, d), "event_id")
    return ingest.admitted(log.where(F.col("blob") == F.lit(FIRST)), "event_id", 12_000).select("event_id", "key")


def put_json_keys(spark, d):
    return events.read(spark, d).select(json_key(F.col("props"), "k").alias("key")).groupBy("key").agg(F.count("*").alias("puts"))


def prefix_increment(spark, d):
    return read.scan(events.log(spark, d), "00001", increment_prefix(b"00001").decode())


def segment_names(spark, d):
    return _files(spark, d).select("blob", segment_name(F.col("created")).alias("name"))


def read_as_of(spark, d):
    return read.scan(read.as_of(events.log(spark, d), datetime(2024, 1, 10, 12)))


def stream_ingest(spark, d):
    return read.scan(ingest.ingested(spark, d))


def _replayed(spark, d, flushed: int = 2) -> Store:
    """A new store into which all events were written in order, in three batches, of which the first ones were flushed."""
    store = Store.init(spark, ingest.scratch(spark, "store"))
    log = events.as_log(events.read(spark, d), "event_id").select("key", "doc", "blob", F.struct("ts", "event_id").alias("at"))
    for k, part in enumerate((F.col("blob") <= "2024-01-10", F.col("blob").between("2024-01-11", "2024-01-20"), F.col("blob") > "2024-01-20")):
        store.write_batch(log.where(part), "at")
        if k < flushed:
            store.flush()
    return store


def store_scan(spark, d):
    return _replayed(spark, d).scan().rows.select("key", F.col("doc").cast("string").alias("doc"))


def store_scan_range(spark, d):
    return _replayed(spark, d).scan("000010", "000050").rows.select("key", F.col("doc").cast("string").alias("doc"))


def store_compacted(spark, d):
    store = _replayed(spark, d, flushed=3)
    store.compact(compact.Options(min_files=3))
    store.vacuum()
    return store.scan().rows.select("key", F.col("doc").cast("string").alias("doc"))


def store_newest_versions(spark, d):
    store = _replayed(spark, d, flushed=3)
    store.compact(compact.Options(gc=compact.GCPolicy(max_versions=2)))
    log = store.log(store.manifest())[0]
    return log.groupBy("key").agg(F.count("*").alias("versions"), F.count_if("tombstone").alias("deletes"))


def store_get_batch(spark, d):
    asked = spark.read.parquet(f"{d}/customer.parquet").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("key"))
    return _replayed(spark, d).get_batch(asked).select("key", F.col("doc").cast("string").alias("doc"), "found")


def store_meta(spark, d):
    store = _replayed(spark, d, flushed=3)
    return store.meta().select("min_key", "max_key", "count", "size")


def store_index(spark, d):
    store = _replayed(spark, d, flushed=3)
    store.compact(compact.Options())
    names = [b["blob_id"] for b in store.manifest().blobs]
    return spark.read.parquet(*[f"{store.path}/index/blob_id={n}" for n in names]).select("key", "rn", "offset")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_full": scan_full,
    "scan_range": scan_range,
    "scan_start_only": scan_start_only,
    "scan_end_only": scan_end_only,
    "scan_empty_range": scan_empty_range,
    "scan_prefix": scan_prefix,
    "scan_pruned_blobs": scan_pruned_blobs,
    "scan_stats": scan_stats,
    "get_point": get_point,
    "get_batch": get_batch,
    "get_memtable_first": get_memtable_first,
    "get_empty_value_visible": get_empty_value_visible,
    "get_deleted_keys": get_deleted_keys,
    "get_stats": get_stats,
    "merge_all_versions": merge_all_versions,
    "blob_meta": blob_meta,
    "meta_containing": meta_containing,
    "meta_all": meta_all,
    "index_every_n": index_every_n,
    "index_every_bytes": index_every_bytes,
    "index_lookup": index_lookup,
    "filter_keys": filter_keys,
    "filter_skip": filter_skip,
    **{f"compact_select_{o}": _selected(o, max_files=5) for o in compact.ORDERS},
    "compact_select_max_size": compact_select_max_size,
    "compact_select_time": _selected("oldest", min_time=datetime(2024, 1, 10, 12), max_time=datetime(2024, 1, 20)),
    "compact_output_meta": compact_output_meta,
    "gc_max_age": _collected(max_age=timedelta(days=16)),
    "gc_tombstone_age": _collected(tombstone_age=timedelta(days=2)),
    "gc_max_versions": _collected(max_versions=30),
    "gc_all": _collected(max_age=timedelta(days=16), tombstone_age=timedelta(days=2), max_versions=30),
    "gc_resurrection": gc_resurrection,
    "atomic_swap": atomic_swap,
    "memtable_size": memtable_size,
    "memtable_admission": memtable_admission,
    "put_json_keys": put_json_keys,
    "prefix_increment": prefix_increment,
    "segment_names": segment_names,
    "read_as_of": read_as_of,
    "stream_ingest": stream_ingest,
    "get_stats_totals": get_stats_totals,
    "store_scan": store_scan,
    "store_scan_range": store_scan_range,
    "store_compacted": store_compacted,
    "store_newest_versions": store_newest_versions,
    "store_get_batch": store_get_batch,
    "store_meta": store_meta,
    "store_index": store_index,
}
