"""Decontamination, near copies, sharding, mixing and sketches against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import common, decontaminate, mixing, sharding, simhash, sketches
from tidelog.llm.components import components

from . import plain

ITEMS = [(1, "the Moon rises over the quiet river and the stone bridge tonight again"), (2, "short item here"), (3, None), (4, "..."), (5, "short item here"), (12, "one two three four five six seven eight nine ten eleven")]


def windows(text, size=10):
    w = plain.words(text)
    k = min(size, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def plain_hits(text, items):
    w, hit, found = plain.words(text), set(), set()
    for item, t in items:
        for win in windows(t):
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_decontamination(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    rows = plain.documents() + [
        (101, "x SHORT, item... here y short item here"),
        (102, ITEMS[0][1] + " " + ITEMS[0][1]),
        (103, "zz two three four five six seven eight nine ten eleven"),
        (104, "one two three four five six seven eight nine"),
        (105, "short item\x00here"),
        (106, "éshort item here"),
    ]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.annotate(plain.frame(spark, rows, n="clash"), items).collect()
    have = sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])) for r in got)
    assert have == sorted(str((i, *plain_hits(t, ITEMS))) for i, t in rows)
    left = decontaminate.clean(plain.frame(spark, rows), items)
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, t in rows if not plain_hits(t, ITEMS)[4])


def test_no_words_are_shuffled(spark):
    """Beyond the broadcast only keys, positions and hashes of documents move."""
    items = decontaminate.item_windows(spark.createDataFrame(ITEMS, "item_id long, text string"))
    by_hash = items.where("len = 10").select(F.xxhash64("words").alias("hash"), "len", "words", F.lit(1).alias("window"))
    df = decontaminate.hits(plain.frame(spark, plain.documents()), by_hash, [10], False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    moved = [m for m in re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan) if "text_hash#" in m]
    assert moved and all(set(re.findall(r"([a-z_]+)#", m)) <= {"doc_id", "text_hash", "n", "p", "hash"} for m in moved)


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.annotate(plain.frame(spark, plain.documents()), none)
    assert got.where("contaminated").count() == 0 and got.count() == len(plain.documents())
    assert decontaminate.annotate(plain.frame(spark, plain.documents()).limit(0), none).count() == 0


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, edges):
    at = list(range(n))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        at[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_simhash_classes(spark):
    rows = plain.documents()
    rng = random.Random(3)
    near = plain.sentence(rng, 400).split()
    for i in range(30):
        other = list(near)
        other[rng.randrange(400)] = f"w{i}"
        rows.append((200 + i, " ".join(other)))
    fp = [plain_fingerprint(t) for _, t in rows]
    root = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4])
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    want = sorted(str((i, f"{f:016x}", least.get(r))) for (i, _), f, r in zip(rows, fp, root, strict=True))
    got = simhash.classes(plain.frame(spark, rows, fp="clash")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id")
    assert sorted(str(tuple(r)) for r in got.collect()) == want


@pytest.mark.parametrize(("radius", "block"), [(4, 2048), (4, 5), (1, 2048), (1, 3), (2, 3), (3, 2048), (3, 3), (5, 2048), (0, 3)])
def test_links_lose_none(spark, radius, block):
    """Clusters, whose buckets are compared in a block or met in midpoints: true links only, and the components of all."""
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:6]:
        for _ in range(12):
            x = v
            for b in rng.sample(range(64), rng.randrange(1, radius + 3)):
                x ^= 1 << b
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, block).collect()
    place = {v: i for i, v in enumerate(signed)}
    mine = [(place[r["a"]], place[r["b"]]) for r in found]
    assert all((values[a] ^ values[b]).bit_count() <= radius for a, b in mine)
    true = [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= radius]
    assert roots(len(values), mine) == roots(len(values), true)


def test_radius_is_checked(spark):
    with pytest.raises(ValueError, match="radius"):
        simhash.links(spark.createDataFrame([], "fp long"), 6)


def test_masks_cover():
    rng, family = random.Random(0), [m % (1 << 64) for m in simhash.masks()]
    assert len(family) == 31
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flips & m for m in family)


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_deduplication(spark):
    rows, rng = plain.documents(), random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    groups = []
    for g in range(4):
        own = [f"g{g}x{w}" for w in base]
        rows.append((300 + 10 * g, " ".join(own)))
        for k in range(1, 5):
            edited = list(own)
            edited[rng.randrange(300)] = f"edit{k}"
            rows.append((300 + 10 * g + k, " ".join(edited)))
        groups.append(300 + 10 * g)
    rows.append((400, " ".join(f"g0x{w}" if i % 8 else "other" for i, w in enumerate(base))))  # too far
    kept = [r["doc_id"] for r in simhash.deduplicated(plain.frame(spark, rows)).collect()]
    assert sorted(i for i in kept if i and 300 <= i <= 400) == [*groups, 400]
    assert -5 in kept and not {9, 10, 11} & set(kept)  # copies of -5 and one that adds a word
    assert len(kept) == len(set(kept)) and None in kept
    assert {i for i in kept if i and 20 <= i < 60} == set(range(20, 60))
    assert simhash.deduplicated(plain.frame(spark, rows).limit(0)).count() == 0


def test_sharding(spark):
    rows = plain.documents() + [(1000 + i, "same words") for i in range(60)] + [(2000 + i, f"pair {i // 2}") for i in range(40)]
    df = plain.frame(spark, rows, shard=99, src="clash", slot=1)
    got = sharding.shard_documents(df).collect()
    text = {i: t for i, t in rows}
    assert len(got) == len(rows)
    by = [[r for r in got if r["shard"] == s] for s in range(8)]
    sizes = [len(x) for x in by]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by)
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got)
    where = {r["doc_id"]: r["shard"] for r in got}
    assert sum(where[2000 + i] != where[2001 + i] for i in range(0, 40, 2)) <= 3
    assert sharding.shard_documents(df.limit(0)).count() == 0


def test_driver_memory_is_given_back(spark, monkeypatch):
    assert common.trimmed(spark)  # by the JVM's own command
    calls = []
    monkeypatch.setattr(common, "trimmed", calls.append)
    for _ in range(2 * common.TIDY_EVERY):
        common.written(spark.range(1), "tidy")
    assert len(calls) == 2


def test_sharding_against_brute_force(spark):
    """Small tables: as few documents are cut off from their groups as any placement under the same quotas allows."""
    for seed in range(4):
        rng = random.Random(seed)
        sizes = [rng.randrange(1, 5) for _ in range(rng.randrange(3, 6))]
        rows = [(10 * g + k, f"group {g}") for g, n in enumerate(sizes) for k in range(n)] + [(900 + i, f"alone {i}") for i in range(rng.randrange(0, 6))]
        got = sharding.shard_documents(plain.frame(spark, rows), 2)
        counts = sorted(r["count"] for r in got.groupBy("shard").count().collect())
        assert len(rows) // 2 in counts and max(counts) - min(counts) <= 1
        cut = sharding.cut_links(got, plain.frame(spark, rows)).first()["cut_documents"]
        linked = [n for n in sizes if n > 1]
        alone = len(rows) - sum(linked)
        best = len(rows)
        for split in itertools.product(*[range(n + 1) for n in linked]):  # of each group, how many are in shard 0
            rest = -(-len(rows) // 2) - sum(split)
            if 0 <= rest <= alone:
                best = min(best, sum(min(k, n - k) for k, n in zip(split, linked, strict=True)))
        assert best <= cut <= best + 1


def test_sharding_evens_bytes(spark):
    rng = random.Random(3)
    rows = [(i, "x" * int(rng.paretovariate(1.1) * 20)) for i in range(1500)] + [(5000 + i, "a hot copy") for i in range(700)]
    got = sharding.shard_documents(plain.frame(spark, rows)).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    largest = max(len(t) for _, t in rows)
    assert max(r["n"] for r in got) - min(r["n"] for r in got) <= 1
    assert max(r["b"] for r in got) - min(r["b"] for r in got) <= max(largest, 0.1 * sum(r["b"] for r in got) / 8)


def test_deal():
    dealt = sharding.deal([(8, 10, 1000), (4, 7, 70), (0, 3, 3)], [8, 6, 6], [0, 500, 0])
    assert {c: sum(n for _, n in s) for c, s in dealt.items()} == {8: 10, 4: 7, 0: 3}
    assert [sum(n for s in dealt.values() for i, n in s if i == k) for k in range(3)] == [8, 6, 6]


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, cap = {s: i % 3 + 1 for i, s in enumerate(names)}, {s: 3 * sizes[s] for s in names}
    total, held = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in held]
        level = (total - sum(held.values())) / max(1, sum(weight[s] for s in free))
        over = [s for s in free if level * weight[s] > cap[s]]
        if not over:
            return {s: held.get(s, level * weight[s]) for s in names}
        held |= {s: cap[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 50, None: 10}, {"a": 1, "b": 1, "c": 1000, "d": 2, "e": 1}, {"x": 7}, {"a": 0, "b": 10}])
def test_targets(spark, sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    df = spark.createDataFrame([(s, sizes[s], i % 3 + 1) for i, s in enumerate(names)], "source string, source_size long, weight long")
    got = {r["source"]: r["target"] for r in mixing.targets(df, 3).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix(spark):
    rows = plain.documents() + [(500 + i, "w " * (1 + i % 9)) for i in range(400)]
    df = plain.frame(spark, rows, repeats="clash", target=1)
    got = mixing.mix(mixing.sized(df)).drop("row").collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(mixing.sized(df.repartition(5))).drop("row").collect()))
    size = lambda t: len((t or "").encode().split())
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t in rows)
    sums = {}
    for r in got:
        s = sums.setdefault(r["source"], [0, 0, r["target"], 0, r["source_size"]])
        s[0], s[1], s[3] = s[0] + r["size"], s[1] + r["size"] * r["repeats"], max(s[3], r["size"])
        assert 0 <= r["repeats"] <= 3
    assert {k: v[2] for k, v in sums.items()} == pytest.approx(plain_targets({k: v[0] for k, v in sums.items()}))
    assert all(abs(v[1] - v[2]) <= v[3] / 2 + 1 and v[4] == v[0] for v in sums.values())
    assert mixing.resampled(plain.frame(spark, rows)).count() == sum(r["repeats"] for r in got)
    assert mixing.mix(mixing.sized(df.limit(0))).count() == 0


def test_mix_keeps_columns(spark):
    clash = dict(size=-7, target="mine", repeats=True, source_size=1, order="z", row="r", s="s", bucket=-1, edge=2, __x=5)
    df = plain.frame(spark, plain.documents(), **clash)
    got = mixing.resampled(df)
    assert got.schema == df.schema and got.count() > 0
    assert got.select(*clash).distinct().collect() == [tuple(clash.values())]


@pytest.mark.parametrize("rows", [2_000, 3])
def test_mix_is_its_sql(spark, monkeypatch, tmp_path, rows):
    """Null ids and sources, repeated rows and many buckets included."""
    import duckdb

    monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
    docs = plain.documents() + [(500 + i, "w " * (1 + i % 9)) for i in range(300)] + [(500 + i, "w " * (1 + i % 9)) for i in range(0, 300, 50)]
    plain.frame(spark, docs).coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = sorted(map(str, con.execute(f"select {', '.join(names)} from ({mixing.ORACLE})").fetchall()))
    assert sorted(str(tuple(r)) for r in mixing.query(spark, f"file://{tmp_path}").select(*names).collect()) == want


def shingles(text, size=5):
    w = (text or "").encode().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def test_sketches(spark):
    rows = [(i, t) for i, t in plain.documents() if i is not None and i != 11]
    order = sorted(rows, key=lambda r: -r[0])
    got = {r["doc_id"]: r for r in sketches.compared(plain.frame(spark, rows, sketch="clash")).withColumns({"e": sketches.resemblance(F.col("sketch"), F.col("edited_sketch")), "n": sketches.resemblance(F.col("sketch"), F.col("next_sketch")), "d": sketches.distinct_shingles(F.col("sketch")), "c": sketches.containment(F.col("edited_sketch"), F.col("sketch"))}).collect()}
    assert len(got) == len(rows)
    for at, (i, t) in enumerate(order):
        t, after = t or "", order[(at + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = shingles(t), shingles(edited), shingles(after)
        exact = len(a) <= 60 and len(b) <= 60
        assert r["e"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=1e-9 if exact else 0.15)
        assert r["n"] == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0, abs=0.15)
        assert r["d"] == pytest.approx(len(a), rel=0.3)
        assert r["c"] == pytest.approx(len(a & b) / len(b) if b else 1.0, abs=0.25)


def test_sketches_merge(spark):
    df = spark.createDataFrame([("a b c d e f g h", "d e f g h i j k", "")], "x string, y string, z string")
    for c in ("x", "y", "z"):
        df = sketches.with_sketch(df, c, f"s{c}", k=3)
    r = df.select(sketches.merged(F.col("sx"), F.col("sy"), 3).alias("m"), "sx", "sy", "sz", sketches.resemblance(F.col("sx"), F.col("sz")).alias("r")).first()
    assert r["m"] == sorted(set(r["sx"]) | set(r["sy"]))[:3] and r["sz"] == [] and r["r"] == 0


def test_next_in_ranges(spark):
    rows = [(i * 7 % 101, f"t{i * 7 % 101}") for i in range(101)] + [(None, "none"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.xxhash64("text"))
    got = sketches.with_next(df, "doc_id", "tie", ["doc_id"], 9).collect()
    assert len(got) == 103
    assert sorted((r["next_doc_id"] for r in got if r["doc_id"] not in (None, 5, 6, 0)), reverse=True) == [i - 1 for i in range(100, 0, -1) if i not in (5, 6)]
    assert next(r["next_doc_id"] for r in got if r["doc_id"] is None) == 100 and next(r["next_doc_id"] for r in got if r["doc_id"] == 0) is None
    one = df.where("doc_id = 9")
    assert sketches.with_next(one, "doc_id", "tie", ["doc_id"], 9).first()["next_doc_id"] == 9
    assert sketches.with_next(one.limit(0), "doc_id", "tie", ["doc_id"], 9).count() == 0


def test_queries_over_a_table(spark, sf_dir):
    """The queries of fingerprints, shards and sketches over a whole table, against plain versions."""
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    fp = [plain_fingerprint(t) for _, t in docs]
    root = roots(len(docs), [(a, b) for a in range(len(docs)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 4])
    want = sorted((i, f"{f:016x}", docs[r][0]) for (i, _), f, r in zip(docs, fp, root, strict=True))
    assert sorted(tuple(r) for r in simhash.query(spark, sf_dir).collect()) == want

    got = sharding.query(spark, sf_dir)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = {r["doc_id"]: r for r in got.collect()}
    assert len(got) == len(docs) and all(got[i]["size"] == len((t or "").encode()) + 1 for i, t in docs)
    counts = [sum(r["shard"] == s for r in got.values()) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    groups = {}
    for i, t in docs:
        groups.setdefault(t, []).append(got[i]["shard"])
    assert sum(len(set(g)) > 1 for g in groups.values()) <= 8

    got = {r["doc_id"]: r for r in sketches.query(spark, sf_dir).collect()}
    order = docs[::-1]
    for at, (i, t) in enumerate(order):
        t, after = t or "", order[(at + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = shingles(t), shingles(edited), shingles(after)
        assert got[i]["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0, abs=0.2)
        assert got[i]["near_next"] == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0, abs=0.2)


def test_clashing_columns(spark):
    """Results keep their own columns where documents have some of the same names."""
    clash = dict(component_id=-1, fp="x", shard=-1, slot=-1, size="s", law="l", least=0, bucket=0, root=0)
    df = plain.frame(spark, plain.documents(), **clash)
    same = plain.frame(spark, plain.documents())
    key = lambda d: sorted(map(str, d.collect()))
    assert key(simhash.classes(df)) == key(simhash.classes(same))
    assert key(sharding.shard_documents(df)) == key(sharding.shard_documents(same))
