"""The SQL that each query of `queries` is held against, for DuckDB over the same tables."""

from __future__ import annotations

LOG = """log as (
  select lpad(cast(user_id as varchar), 6, '0') as key, cast(date_trunc('millisecond', ts) as timestamp) as ts,
         case when event_type = 'error' then null when event_type = 'signup' and event_id % 3 = 0 then '' else props end as doc,
         event_type = 'error' as tombstone, strftime(ts, '%Y-%m-%d') as blob, event_id
  from events)"""
BYTES = "(case when doc is null then 32 else 37 + octet_length(encode(doc)) end + octet_length(encode(key)) + case when tombstone then 12 else 0 end)"
META = f"""meta as (
  select blob, min(key) as min_key, max(key) as max_key, min(ts) as min_time, max(ts) as max_time, count(*) as count,
         cast(sum({BYTES}) + 6 as bigint) as size, cast(cast(blob as date) + interval 1 day as timestamp) as created
  from log group by blob)"""
PLACED = f"""placed as (
  select *, row_number() over w as rn,
         cast(6 + coalesce(sum({BYTES}) over (partition by blob order by key, ts desc rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset",
         {BYTES} as bytes
  from log window w as (partition by blob order by key, ts desc))"""
PROBES = "probe as (select unnest(['000007', '000042', '000111']) as k)"


def _newest(where: str = "true", order: str = "ts desc", source: str = "log") -> str:
    return f"(select * from (select *, row_number() over (partition by key order by {order}) as v from {source} where {where}) where v = 1)"


def _scan(where: str = "true", source: str = "log") -> str:
    return f"with {LOG} select key, doc, ts from {_newest(where, source=source)} where octet_length(encode(doc)) > 0"


def _select(order: str) -> str:
    by = {"oldest": "created", "newest": "created desc", "smallest": "size", "largest": "size desc"}[order]
    return f"with {LOG}, {META} select row_number() over (order by {by}, blob) as ord, blob, size from meta qualify ord <= 5"


def _fold(name: str, by: str) -> str:
    return f"""{name}_o as (select row_number() over (order by {by}, blob) as i, blob, size from meta),
{name}_f as (
  select cast(0 as bigint) as i, cast(0 as bigint) as total, cast(0 as bigint) as n, false as took
  union all
  select o.i, case when f.total + o.size <= 60000 then f.total + o.size else f.total end,
         case when f.total + o.size <= 60000 then f.n + 1 else f.n end, f.total + o.size <= 60000
  from {name}_f f join {name}_o o on o.i = f.i + 1)"""


def _kept(*rules: str, versions: str = "true") -> str:
    return f"with {LOG} select key, ts, doc, tombstone from (select *, row_number() over (partition by key order by ts desc) as v from log where {' and '.join(rules) or 'true'}) where {versions}"


AGE, TOMB = "ts >= timestamp '2024-01-15'", "not (tombstone and ts < timestamp '2024-01-29')"
MERGED = f"""merged as (
  select min(key) as min_key, max(key) as max_key, min(ts) as min_time, max(ts) as max_time, count(*) as count, cast(sum({BYTES}) + 6 as bigint) as size
  from log where blob in (select blob from meta order by created, blob limit 5))"""

ASKED = "asked as (select distinct lpad(cast(c_custkey as varchar), 6, '0') as key from customer)"
PARTS = "case when blob <= '2024-01-10' then 1 when blob <= '2024-01-20' then 2 else 3 end"


def _live(where: str = "true") -> str:
    """What a store that took the events in order has: time, then event_id, tell which came last."""
    return f"with {LOG} select key, doc from {_newest(where, order='ts desc, event_id desc')} where octet_length(encode(doc)) > 0"


ORACLE_SQL: dict[str, str] = {
    "scan_full": _scan(),
    "scan_range": _scan("key >= '000010' and key < '000050'"),
    "scan_start_only": _scan("key >= '000090'"),
    "scan_end_only": _scan("key < '000030'"),
    "scan_empty_range": _scan("key >= '000010' and key < '000010'"),
    "scan_prefix": _scan("starts_with(key, '00001')"),
    "prefix_increment": _scan("starts_with(key, '00001')"),
    "read_as_of": _scan("ts <= timestamp '2024-01-10 12:00:00'"),
    "stream_ingest": _scan(),
    "scan_pruned_blobs": f"""with {LOG}, m as (
  select key[1:5] as blob, min(key) as min_key, max(key) as max_key, count(*) as count, cast(sum({BYTES}) + 6 as bigint) as size from log group by 1)
select * from m where not (min_key >= '000061') and not (max_key < '000025')""",
    "scan_stats": f"""with {LOG}, r as (select count(*) as n from {_newest("key >= '000010' and key < '000050'")} where octet_length(encode(doc)) > 0),
z as (select blob, min(key) as lo, max(key) as hi from log group by blob)
select (select n from r) as records_returned, count(*) filter (blob = '2024-01-30') as memtables_read,
       count(*) filter (blob <> '2024-01-30' and hi >= '000010' and lo < '000050') as sstables_read from z""",
    "get_point": f"with {LOG} select key, doc, ts from {_newest("key = '000007'")} where not tombstone",
    "get_batch": f"""with {LOG}, asked as (select distinct lpad(cast(c_custkey as varchar), 6, '0') as key from customer),
hit as (select key, doc, ts from {_newest()} where not tombstone)
select a.key, h.doc, h.ts, h.key is not null as found from asked a left join hit h on h.key = a.key""",
    "get_memtable_first": f"with {LOG} select key, doc, ts from {_newest(order="(blob = '2024-01-15') desc, ts desc")} where not tombstone",
    "get_empty_value_visible": f"with {LOG} select key, doc, ts from {_newest()} where not tombstone",
    "get_deleted_keys": f"with {LOG} select key, ts from {_newest()} where tombstone",
    "get_stats": f"""with {LOG}, {META}, {PLACED}, {PROBES},
c as (select blob, k from meta, probe where k between min_key and max_key),
f as (select blob, key as k, min(rn) as at from placed where key in (select k from probe) group by all),
e as (select blob, k, max(rn) as start from placed, probe where (rn - 1) % 8 = 0 and key < k group by all)
select c.k as key, count(f.at) as blobs_fetched, count(*) - count(f.at) as blobs_skipped,
       cast(coalesce(sum(case when f.at is not null then f.at - coalesce(e.start, 1) + 1 end), 0) as bigint) as records_scanned
from c left join f on f.blob = c.blob and f.k = c.k left join e on e.blob = c.blob and e.k = c.k group by c.k""",
    "merge_all_versions": f"""with {LOG} select key, ts, doc, tombstone, row_number() over (partition by key order by ts desc) as version
from log where blob in ('2024-01-01', '2024-01-05', '2024-01-10')""",
    "blob_meta": f"with {LOG}, {META} select * exclude (created) from meta",
    "meta_containing": f"""with {LOG}, {META} select blob, row_number() over (order by max_time desc, created desc) as ord
from meta where min_key <= '000003' and max_key >= '000003'""",
    "meta_all": f"with {LOG}, {META} select blob, min_key, row_number() over (order by min_key, max_time desc) as ord from meta",
    "index_every_n": f"""with {LOG}, {PLACED} select blob, key, "offset" from placed where (rn - 1) % 8 = 0""",
    "index_every_bytes": f"""with recursive {LOG}, {PLACED},
walk as (
  select blob, rn, key, "offset", bytes as since, true as entry from placed where rn = 1
  union all
  select p.blob, p.rn, p.key, p."offset", case when w.since >= 256 then p.bytes else w.since + p.bytes end, w.since >= 256
  from walk w join placed p on p.blob = w.blob and p.rn = w.rn + 1)
select blob, key, "offset" from walk where entry""",
    "index_lookup": f"""with {LOG}, {PLACED}, {PROBES}, i as (select blob, key, "offset" as o from placed where (rn - 1) % 8 = 0)
select blob, k as key, coalesce(max(o) filter (key < k), min(o)) as first, coalesce(min(o) filter (key > k) - 1, 0) as last
from i, probe group by blob, k having min(key) <= k""",
    "filter_keys": f"with {LOG} select distinct blob, key from log",
    "filter_skip": f"""with {LOG}, {META}, probe as (select unnest(['000007', '000042', '000111', '000500']) as key)
select blob, key from meta, probe where key between min_key and max_key and not exists (select 1 from log l where l.blob = meta.blob and l.key = probe.key)""",
    **{f"compact_select_{o}": _select(o) for o in ("oldest", "newest", "smallest", "largest")},
    "compact_select_max_size": f"""with recursive {LOG}, {META}, {_fold("s", "size")}, {_fold("n", "created desc")}
select f.n as ord, o.blob, o.size, 'smallest' as ordering from s_f f join s_o o on o.i = f.i where f.took
union all select f.n, o.blob, o.size, 'newest' from n_f f join n_o o on o.i = f.i where f.took""",
    "compact_select_time": f"""with {LOG}, {META} select row_number() over (order by created, blob) as ord, blob, size
from meta where not (max_time < timestamp '2024-01-10 12:00:00') and not (min_time > timestamp '2024-01-20')""",
    "compact_output_meta": f"with {LOG}, {META}, {MERGED} select 'merged' as blob, * from merged",
    "gc_max_age": _kept(AGE),
    "gc_tombstone_age": _kept(TOMB),
    "gc_max_versions": _kept(versions="v <= 30"),
    "gc_all": _kept(AGE, TOMB, versions="v <= 30"),
    "gc_resurrection": _scan("not (tombstone and ts < timestamp '2024-01-31')"),
    "atomic_swap": f"""with {LOG}, {META}, {MERGED}, gone as (select blob from meta order by created, blob limit 5)
select * from meta where blob not in (select blob from gone)
union all select '2024-02-01', min_key, max_key, min_time, max_time, count, size, timestamp '2024-02-01' from merged""",
    "memtable_size": f"""with {LOG} select cast(sum(octet_length(encode(key)) + coalesce(octet_length(encode(doc)), 0) + 100) as bigint) as bytes, count(*) as records
from log where blob = '2024-01-01'""",
    "memtable_admission": f"""with recursive {LOG},
o as (select row_number() over (order by event_id) as i, event_id, key, octet_length(encode(key)) + coalesce(octet_length(encode(doc)), 0) + 100 as est from log where blob = '2024-01-01'),
f as (
  select cast(0 as bigint) as i, cast(0 as bigint) as total, false as took
  union all
  select o.i, case when f.total + o.est <= 12000 then f.total + o.est else f.total end, f.total + o.est <= 12000 from f join o on o.i = f.i + 1)
select o.event_id, o.key from f join o on o.i = f.i where f.took""",
    "put_json_keys": "select json_extract_string(props, '$.k') as key, count(*) as puts from events group by 1",
    "segment_names": f"with {LOG}, {META} select blob, cast(epoch_ms(created) as varchar) || '.sstable' as name from meta",
    "get_stats_totals": f"""with {LOG}, {META}, {PLACED}, {ASKED}, probe as (select key as k from asked),
c as (select blob, k from meta, probe where k between min_key and max_key),
f as (select blob, key as k, min(rn) as at from placed group by all),
x as (select c.k, sum(case when f.at is not null then f.at - case when f.at > 1 then ((f.at - 2) // 8) * 8 + 1 else 1 end + 1 else 0 end) as n
      from c left join f on f.blob = c.blob and f.k = c.k group by c.k)
select count(*) as keys, cast(coalesce(sum(n), 0) as bigint) as total_scanned, cast(max(n) as bigint) as max_scanned, avg(n) as mean_scanned from x""",
    "store_scan": _live(),
    "store_scan_range": _live("key >= '000010' and key < '000050'"),
    "store_compacted": _live(),
    "store_newest_versions": f"""with {LOG}, v as (select *, row_number() over (partition by key order by ts desc, event_id desc) as v from log)
select key, count(*) as versions, count(*) filter (tombstone) as deletes from v where v <= 2 group by key""",
    "store_get_batch": f"""with {LOG}, {ASKED}, hit as (select key, doc from {_newest(order="ts desc, event_id desc")} where not tombstone)
select a.key, h.doc, h.key is not null as found from asked a left join hit h on h.key = a.key""",
    "store_meta": f"""with {LOG} select min(key) as min_key, max(key) as max_key, count(*) as count, cast(sum({BYTES}) + 6 as bigint) as size from log group by {PARTS}""",
    "store_index": f"""with {LOG}, p as (
  select key, row_number() over w as rn,
         cast(6 + coalesce(sum({BYTES}) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset"
  from log window w as (order by key, ts desc, event_id desc))
select key, rn, "offset" from p where (rn - 1) % 32 = 0""",
}
