"""Operators over generated tables, against plain versions over lists."""

import itertools
import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelog.cli import id_text
from tidelog.errors import Conflict, InvalidRange, NoRecords
from tidelog.functions import scalar
from tidelog.operators import access, compact, meta, read
from tidelog.streaming.ingest import admitted

T = datetime(2024, 1, 1)
LOG = "key string, ts timestamp_ntz, doc string, tombstone boolean, blob string"


def log(spark, rows):
    return spark.createDataFrame([(k, T + timedelta(hours=h), d, d is None, b) for k, h, d, b in rows], LOG)


def keys(spark, *k):
    return spark.createDataFrame([(x,) for x in k], "key string")


def test_prefix():
    assert [scalar.increment_prefix(p) for p in (b"a", b"a\xff", b"\xff\xff", b"", b"az")] == [b"b", b"b", b"", b"", b"a{"]
    assert scalar.fnv1a(b"") == 0xCBF29CE484222325 and scalar.fnv1a(b"a") == 0xAF63DC4C8601EC8C


def plain_number(value):
    """A JSON number's text by the decimal module: the fewest digits that read back."""
    if value == 0:
        return "-0" if str(value)[0] == "-" else "0"
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    text, power = "".join(map(str, digits)), len(digits) + exponent - 1
    minus = "-" * sign
    if -4 <= power < 6:
        return minus + format(Decimal(repr(abs(value))).normalize(), "f")
    return f"{minus}{text[0]}{'.' + text[1:] if len(text) > 1 else ''}e{'-' if power < 0 else '+'}{abs(power):02d}"


def numbers():
    rng = random.Random(11)
    out = [0, -0.0, 7, -3, 10**5, 10**6, 10**6 - 1, 2.5e6, 1.5, 1e-4, 9.9e-5, 1e22, -4.25e-9, 2**53, 3e150]
    return out + [rng.uniform(-1, 1) * 10 ** rng.randrange(-9, 14) for _ in range(150)] + [rng.randrange(-(10**9), 10**9) for _ in range(50)]


def test_number_text():
    assert [scalar.number_text(float(v)) for v in numbers()] == [plain_number(float(v)) for v in numbers()]


def test_json_key(spark):
    """The column form against the scalar one, with values that only look like something else."""
    values = [*numbers(), "x", "1e6", "12.50", "", True, False, [1, "a"], {"b": 1}, "é\n\"q\""]
    docs = [json.dumps({"_id": v}) for v in values]
    want = [id_text(v) for v in values]
    docs += ['{"a": {"_id": "inner"}, "_id": 5000000}', '{"_id": 2.50}', '{"a": "\\"_id\\": \\"t\\"", "_id": 3e7}', '{"a": 1}', '{"_id": null}']
    want += ["5e+06", "2.5", "3e+07", None, None]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, d string")
    assert [r["k"] for r in df.select("i", scalar.json_key(F.col("d")).alias("k")).orderBy("i").collect()] == want


def some_keys(rng, n):
    """Keys of few characters, so that prefixes, neighbours and equal ones are common; some beyond ASCII."""
    return ["".join(rng.choice("mnoß語\U0001f409") for _ in range(rng.randrange(1, 5))) for _ in range(n)]


def test_ranges(spark):
    rng = random.Random(21)
    held = sorted(set(some_keys(rng, 60)), key=str.encode)
    df = log(spark, [(k, 0, "v", "f") for k in held])
    bounds = [("", ""), *((rng.choice(["", *held, *some_keys(rng, 5)]), rng.choice(["", *held, *some_keys(rng, 5)])) for _ in range(25))]
    for start, end in bounds:
        if end and start.encode() > end.encode():
            with pytest.raises(InvalidRange):
                read.scan(df, start, end)
            continue
        want = [k for k in held if start.encode() <= k.encode() and (not end or k.encode() < end.encode())]
        assert [r["key"] for r in read.scan(df, start, end).collect()] == want
    for prefix in ("m", "ß", "語\U0001f409", "absent"):
        assert [r["key"] for r in read.scan(df, prefix=prefix).collect()] == [k for k in held if k.startswith(prefix)]


def test_liveness(spark):
    df = log(spark, [("a", 1, "old", "f"), ("a", 2, "", "f"), ("b", 1, "v", "f"), ("b", 2, None, "f"), ("c", 1, "v", "f")])
    assert [r["key"] for r in read.scan(df).collect()] == ["c"]
    assert {r["key"] for r in read.live_by_flag(read.newest(df)).collect()} == {"a", "c"}
    assert read.get(df, "b").count() == 0
    got = {r["key"]: (r["doc"], r["found"]) for r in read.get_batch(df, keys(spark, "a", "b", "z", "a")).collect()}
    assert got == {"a": ("", True), "b": (None, False), "z": (None, False)}


def test_merge_keeps_versions(spark):
    rng = random.Random(17)
    hours = rng.sample(range(500), 45)
    rows = [(rng.choice(["p", "pq", "q", "ß"]), h, f"at {h}", "s") for h in hours]
    got = read.merge_versions(*(log(spark, rows[k::3]) for k in range(3))).collect()
    assert [(r["key"], r["doc"]) for r in got] == [(k, d) for k, _, d, _ in sorted(rows, key=lambda r: (r[0].encode(), -r[1]))]


@pytest.mark.parametrize("many", [100_000, 0])
def test_index_lookup(spark, monkeypatch, many):
    """Repeated entries included, and more asked keys than one array takes."""
    monkeypatch.setattr(read, "ASKED_KEYS", many)
    rng, rows = random.Random(31), []
    for blob in ("one", "two", "six"):
        at = 6
        for k in sorted(some_keys(rng, 12), key=str.encode):
            rows.append((blob, k, at))
            at += rng.randrange(40, 90)
    asked = sorted({*some_keys(rng, 25), *(k for _, k, _ in rows[:6])})
    want = set()
    for blob in ("one", "two", "six"):
        entries = [(k.encode(), o) for b, k, o in rows if b == blob]
        for key in asked:
            k = key.encode()
            if k >= entries[0][0]:
                first = max((o for e, o in entries if e < k), default=entries[0][1])
                last = min((o - 1 for e, o in entries if e > k), default=0)
                want.add((blob, key, first, last))
    index = spark.createDataFrame(rows, "blob string, key string, offset long")
    assert {tuple(r) for r in access.lookup(index, keys(spark, *asked)).select("blob", "key", "first", "last").collect()} == want


def sized(rng, n):
    """(key, hour, doc, blob) with documents of many sizes, several versions of a key and some tombstones."""
    return [(k, h, None if rng.random() < 0.1 else "d" * rng.randrange(120), rng.choice(["p", "q"])) for h, k in enumerate(some_keys(rng, n))]


def in_order(rows, blob):
    """key, offset, bytes of a segment's records, by key and newest first."""
    out, at = [], 6
    for k, _, d, _ in sorted((r for r in rows if r[3] == blob), key=lambda r: (r[0].encode(), -r[1])):
        size = len(k.encode()) + (32 + 12 if d is None else 37 + len(d))
        out.append((k, at, size))
        at += size
    return out


def test_indexes(spark, monkeypatch):
    rows = sized(random.Random(41), 150)
    df = log(spark, rows)
    by_records, by_bytes = set(), set()
    for blob in ("p", "q"):
        since = None
        for i, (k, at, size) in enumerate(in_order(rows, blob)):
            if i % 7 == 0:
                by_records.add((blob, k, at))
            if since is None or since >= 500:
                by_bytes.add((blob, k, at))
                since = 0
            since += size
    assert {tuple(r) for r in access.index_every_records(df, 7).select("blob", "key", "offset").collect()} == by_records
    for batch in ("10000", "4"):  # a segment in one batch, and in many
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert {tuple(r) for r in access.index_every_bytes(df, 500).select("blob", "key", "offset").collect()} == by_bytes
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


@pytest.mark.parametrize("many", [100_000, 0])
def test_get_stats(spark, monkeypatch, many):
    monkeypatch.setattr(read, "ASKED_KEYS", many)
    rng = random.Random(51)
    rows = sized(rng, 120)
    asked, want = sorted({*some_keys(rng, 20), *(r[0] for r in rows[:10])}), {}
    for key in asked:
        fetched = skipped = scanned = 0
        for blob in ("p", "q"):
            held = [k.encode() for k, _, _ in in_order(rows, blob)]
            if not held[0] <= key.encode() <= held[-1]:
                continue
            if key.encode() not in held:
                skipped += 1
                continue
            at = held.index(key.encode())
            entry = max((i for i in range(0, len(held), 8) if held[i] < key.encode()), default=0)
            fetched, scanned = fetched + 1, scanned + at - entry + 1
        if fetched or skipped:
            want[key] = (fetched, skipped, scanned)
    got = read.get_stats(log(spark, rows), keys(spark, *asked))
    assert {r["key"]: (r["blobs_fetched"], r["blobs_skipped"], r["records_scanned"]) for r in got.collect()} == want
    total = read.scanned_totals(got).first()
    assert (total["keys"], total["total_scanned"], total["max_scanned"]) == (len(want), sum(v[2] for v in want.values()), max(v[2] for v in want.values()))


@pytest.mark.parametrize("many", [100_000, 0])
def test_get_stats_makes_no_row_for_each_key_and_segment(spark, monkeypatch, many):
    monkeypatch.setattr(read, "ASKED_KEYS", many)
    monkeypatch.setattr(read, "RANGE_KEYS", 20, raising=False)  # several ranges
    names = [f"{i:06d}" for i in range(400)]
    schema = "key string, ts timestamp, doc string, tombstone boolean, blob string"
    rows = [(k, None, "", False, f"s{b:02d}") for b in range(40) for k in (names[0], names[b], names[b], names[-1])]
    rows += [(None, None, "", False, f"s{b:02d}") for b in range(40)]  # a record without a key has no place
    got = read.get_stats(spark.createDataFrame(rows, schema), keys(spark, *names))
    seen = {r["key"]: tuple(r)[1:] for r in got.collect()}
    want = {k: (0, 40, 0) for k in names} | {names[b]: (1, 39, 2) for b in range(1, 40)}
    assert seen == want | {names[0]: (40, 0, 40), names[-1]: (40, 0, 40 * 4)}
    # Whatever the operators make is within the log's and the asked keys' rows, not their product (16,000).
    made = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        inner = "executedPlan" if kind == "AdaptiveSparkPlanExec" else "plan" if kind.endswith("QueryStageExec") else None
        for metric in ("numOutputRows", "shuffleRecordsWritten"):
            found = node.metrics().get(metric)
            made.extend([found.get().value()] if found.isDefined() else [])
        for child in [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]:
            walk(child)

    walk(got._jdf.queryExecution().executedPlan())
    assert made and max(made) <= len(rows) + len(names)


def test_membership(spark):
    many = spark.range(10_000).selectExpr("cast(id * 100 as string) as key")
    held = access.Membership.build(many)
    assert all(held.contains(str(i * 100)) for i in range(0, 10_000, 97))
    assert sum(held.contains(f"x{i}") for i in range(10_000)) < 100
    assert access.Membership.from_bytes(held.to_bytes()).contains("500")
    with pytest.raises(NoRecords):
        access.Membership.build(many.where("false"))


def files(rng, n):
    """(blob, min_key, max_key, min_time, max_time, created, size): hours, with ties in each column."""
    out = []
    for i in range(n):
        (lo, hi), (a, b) = sorted(some_keys(rng, 2), key=str.encode), sorted(rng.choices(range(12), k=2))
        out.append((f"b{i:02d}", lo, hi, a, b, rng.randrange(12), 10 * rng.randrange(1, 9)))
    return out


def as_meta(spark, rows):
    schema = "blob string, min_key string, max_key string, min_time timestamp_ntz, max_time timestamp_ntz, created timestamp_ntz, size long"
    return spark.createDataFrame([(n, lo, hi, T + a * H, T + b * H, T + c * H, s) for n, lo, hi, a, b, c, s in rows], schema)


H = timedelta(hours=1)


def test_meta_lookup(spark):
    rng = random.Random(61)
    rows = files(rng, 15)
    df = as_meta(spark, rows)
    for key in some_keys(rng, 8) + [rows[0][1], rows[1][2]]:
        hit = [r for r in rows if r[1].encode() <= key.encode() <= r[2].encode()]
        found = meta.containing(df, key).orderBy("ord").collect()
        assert {r["blob"] for r in found} == {r[0] for r in hit}
        by = {r[0]: (r[4], r[5]) for r in rows}
        assert [by[r["blob"]] for r in found] == sorted((by[r[0]] for r in hit), reverse=True)
    with pytest.raises(Conflict):
        meta.swapped(df, as_meta(spark, files(rng, 1)).withColumn("blob", F.lit("absent")), df.limit(0), check=True)


def plain_select(rows, o):
    """The choice rules over lists: a file that doesn't fit is passed over."""
    column, up = {"oldest": (5, 1), "newest": (5, -1), "smallest": (6, 1), "largest": (6, -1)}[o.order]
    hours = lambda t: (t - T) / H
    seen = [r for r in rows if (o.min_time is None or r[4] >= hours(o.min_time)) and (o.max_time is None or r[3] <= hours(o.max_time))]
    taken, total = [], 0
    for r in sorted(seen, key=lambda r: (up * r[column], r[0])):
        if (not o.max_files or len(taken) < o.max_files) and (not o.max_size or total + r[6] <= o.max_size):
            taken, total = [*taken, r[0]], total + r[6]
    return taken if len(taken) >= o.min_files and total >= o.min_size else []


def test_select(spark):
    rng = random.Random(71)
    for _ in range(14):
        rows = files(rng, rng.choice([0, 1, 6, 9]))
        pick = lambda *v: rng.choice([0, 0, *v])
        time = lambda: rng.choice([None, None, T + rng.randrange(12) * H])
        o = compact.Options(rng.choice(list(compact.ORDERS)), pick(2, 4), pick(1, 3, 5), pick(90, 200), pick(70, 130, 220), time(), time())
        assert [r["blob"] for r in compact.select(as_meta(spark, rows), o).orderBy("ord").collect()] == plain_select(rows, o), (rows, o)
    with pytest.raises(ValueError, match="negative"):
        compact.Options(max_size=-1)


def test_retention(spark):
    """Ages are exclusive, a tombstone that goes takes no place, and each key is by itself."""
    rng = random.Random(81)
    rows = [(k, -h, None if rng.random() < 0.4 else f"{k}{h}", "f") for k in ("u", "v", "w") for h in rng.sample(range(1, 30), 9)]
    for versions, age, dead in itertools.product((0, 1, 3), (0, 6, 15), (0, 4, 11)):
        want = set()
        for key in ("u", "v", "w"):
            left = sorted((h for k, h, d, _ in rows if k == key and (not age or -h <= age) and not (dead and d is None and -h > dead)), reverse=True)
            want |= {(key, h) for h in (left[:versions] if versions else left)}
        got = compact.collect_garbage(log(spark, rows), compact.GCPolicy(versions, age * H, dead * H), T)
        assert {(r["key"], (r["ts"] - T) // H) for r in got.collect()} == want


@pytest.mark.parametrize("partitions", [1, 6])
def test_admission(spark, partitions):
    """One pass over lists: what doesn't fit is passed over and takes no room."""
    rng = random.Random(91)
    rows = [(i, rng.choice(["k", "longer key"]), "x" * rng.choice([0, 5, 200, 900])) for i in range(120)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    for limit in (0, 99, 1500, 9000, 10**6):
        want, total = [], 0
        for i, k, d in rows:
            if total + len(k) + len(d) + 100 <= limit:
                want.append(i)
                total += len(k) + len(d) + 100
        df = spark.createDataFrame(rows, "i int, key string, doc string").repartition(3)
        assert [r["i"] for r in admitted(df, "i", limit).orderBy("i").collect()] == want
    spark.conf.set("spark.sql.shuffle.partitions", before)
