"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

Fingerprint: XXH64 (seed 42) of every 4-word shingle, repeats included; a bit is set where over half the hashes have it.

Links: Pagh's covering family. Each bit position gets a vector of r + 1 bits, and each of the 2**(r+1) - 1 nonzero
vectors v gives a mask: the positions whose vectors aren't orthogonal to v. For any r positions some v is orthogonal
to all their vectors, so two fingerprints that differ in r bits or fewer agree on at least one mask. No pair within
the radius is ever missed.

Work is on distinct fingerprints, so exact copies cost nothing. Buckets of two come out of the count itself. Larger
ones, up to BLOCK, are compared inside one task, which puts out a spanning forest of the links, not all pairs. The
members of buckets above BLOCK meet in midpoints instead. Any two within r bits have a value between them that is within
floor(r/2) of one and ceil(r/2) of the other, and whatever is within these of one value is within r of each other. So
each value's smallest member at floor(r/2) is linked with all at ceil(r/2): exact, and linear in the bucket.

Results: null and empty texts have no words, fingerprint zero, and link like any other. Texts of fewer than 4 words
are one shingle. Repeated rows are kept. The component of a null doc_id's row is the smallest id it reaches.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common
from tidelog.llm.components import components
from tidelog.llm.idstore import mixed

BITS, RADIUS, SHINGLE = 64, 4, 4
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(rb"[\x20\x09-\x0D]+")
#: Largest bucket that one task compares by itself.
BLOCK = 512
#: Buckets of three and more, 16 bytes each, that are broadcast to find their members; beyond it both sides are shuffled.
BROADCAST_BUCKETS = 500_000
#: One of so many texts is asked which shingles are frequent, FREQUENT of which are known at most. Only the work depends on it.
SAMPLED, FREQUENT = 16, 100_000
#: Turns in which a node is compared with one other before all pairs of different components are: one at least, and as long
#: as these pairs would be more than the rows that they come from, but so many at most.
MAX_TURNS = 1
#: Bits of a set's parities, a multiple of 64, by which pairs are left out that differ in too many shingles.
PARITIES = 512
#: Shingles that a pair must share at the beginning of its sets, where the prefixes hold so many. Only the work depends on it.
MEETINGS = 4
#: Rows of texts' keys, 80 bytes each at most, that are broadcast.
BROADCAST_ROWS = 200_000


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = np.array([xxh64_intdigest(joined, 42)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        begins = np.append(0, ends[:-1] + 1)
        a, b = begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
        hashes = np.array([xxh64_intdigest(joined[i:j], 42) for i, j in zip(a, b, strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, *, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id and `fp`, the fingerprint as a signed long."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            got = np.array([fingerprint(t or b"", size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS, seed: int = 1) -> list[int]:
    """The covering masks, as signed longs."""
    vectors = np.random.default_rng(seed).integers(0, 1 << (radius + 1), BITS)
    out = []
    for v in range(1, 1 << (radius + 1)):
        bits = sum(1 << i for i in range(BITS) if int(v & vectors[i]).bit_count() % 2)
        out.append(bits - (1 << BITS) if bits >> (BITS - 1) else bits)
    return out


def _forest(block: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all of a bucket's fingerprints which links within the radius join, the closest ones (Prim)."""
    out, left = [], np.arange(1, len(block))
    near = np.bitwise_count(block[1:] ^ block[0])
    parent = np.zeros(len(left), np.int64)
    while len(left):
        k = int(near.argmin())
        at = left[k]
        if near[k] <= radius:
            out.append((int(block[parent[k]].view(np.int64)), int(block[at].view(np.int64))))
        left, near, parent = np.delete(left, k), np.delete(near, k), np.delete(parent, k)
        new = np.bitwise_count(block[left] ^ block[at])
        closer = new < near
        near, parent = np.where(closer, new, near), np.where(closer, at, parent)
    return out


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): links among distinct `fp` within the radius, enough to join each component; exact for radius 0 to 5."""
    if not 0 <= radius <= 5:
        raise ValueError("the radius must be from 0 to 5 bits")
    family = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in enumerate(masks(radius))])
    kind = [F.col("kind")] if "kind" in prints.columns else []  # fingerprints of different kinds don't meet
    keyed = prints.select("fp", *kind, F.explode(family).alias("t"))
    keyed = keyed.select("fp", F.xxhash64(*kind, "t.k", F.col("fp").bitwiseAND(F.col("t.m"))).alias("bucket"))
    counted = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    counted = common.written(counted, "buckets")
    close = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= radius
    pairs = counted.where("n = 2").where(close(F.col("a"), F.col("b"))).select("a", "b").distinct()

    several = counted.where("n > 2").select("bucket", "n")
    if several.count() <= BROADCAST_BUCKETS:
        several = F.broadcast(several)
    members = keyed.join(several, "bucket")
    members = common.written(members, "members")
    small = members.where(F.col("n") <= block).repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(values: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
            found = []
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                found += _forest(values[i:j], radius)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        buckets, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            buckets = np.append(buckets, b.column(0).to_numpy())
            values = np.append(values, b.column(1).to_numpy().view(np.uint64))
            edges = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
            if len(edges) > 1:  # the last bucket may go on in the next batch
                yield done(values, edges)
                buckets, values = buckets[edges[-1] :], values[edges[-1] :]
        if len(values):
            yield done(values, np.append(np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])), len(values)))

    compared = small.select("bucket", "fp").mapInArrow(run, "a long, b long")
    met = None
    crowd = members.where(F.col("n") > block).select("fp").distinct()
    if crowd.take(1):
        near, far = _around(crowd, radius // 2), _around(crowd, -(-radius // 2))
        hubs = near.groupBy("z").agg(F.min("fp").alias("b"))
        met = far.join(hubs, "z").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()
    out = pairs.unionByName(compared)
    return (out.unionByName(met) if met is not None else out).distinct()


def _around(prints: DataFrame, flips: int) -> DataFrame:
    """fp and each z within `flips` bits of it."""
    one = "transform(sequence(0, 63), i -> shiftleft(1L, i))"
    two = "flatten(transform(sequence(1, 63), i -> transform(sequence(0, i - 1), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    three = (
        "flatten(flatten(transform(sequence(2, 63), i -> transform(sequence(1, i - 1), j -> "
        "transform(sequence(0, j - 1), k -> shiftleft(1L, i) | shiftleft(1L, j) | shiftleft(1L, k))))))"
    )
    values = ["array(0L)", one, two, three][: flips + 1]
    return prints.select("fp", F.explode(F.expr(f"transform(flatten(array({', '.join(values)})), x -> fp ^ x)")).alias("z"))


def classes(docs: DataFrame, *, text: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of each row."""
    prints = common.written(with_fingerprints(docs, text=text, size=size), "prints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = common.checkpointed(links(distinct.select("fp"), radius))
    roots = components(found)
    # A component's id is its smallest doc_id, not its smallest fingerprint.
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct hashes, ascending, of a text's `size`-word shingles; a shorter text is one shingle.

    Words are lower-cased (A-Z) and without punctuation; a text without any is cut at white space.
    """
    from xxhash import xxh64_intdigest

    words = WORD.findall(text.lower()) or BLANK.split(text)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = mixed(out ^ h[i : i + len(out)], i)
    return np.unique(out)


def _node(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), 42)).view(np.int64))


def _parities(shingles: np.ndarray) -> np.ndarray:
    """Whether the shingles of each of PARITIES classes are odd in number, as longs.

    Each shingle that one of two sets lacks turns one bit, so sets differ in as many shingles at least as in bits here.
    """
    odd = np.bincount((shingles >> np.uint64(32)).astype(np.int64) % PARITIES, minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that many texts have, by a sample of the distinct texts: the most frequent ones, FREQUENT at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t, size) for t in _texts(b, 0)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).distinct()
    counts = texts.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") >= 4)
    counts = common.written(counts, "frequent")
    least, total = None, 0
    for r in sorted(counts.groupBy(F.least("c", F.lit(10_000)).alias("c")).count().collect(), key=lambda r: -r["c"]):
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["c"]
    if least is None:
        return np.zeros(0, np.uint64)
    return np.sort(counts.where(F.col("c") >= least).select("h").toArrow()["h"].to_numpy().view(np.uint64))


def near_copies(docs: DataFrame, *, similarity: float = 0.8, size: int = 5) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, node) of each row and (node, root) of each node that has near copies.

    A node is a distinct set of `size`-word shingles, named by a hash. Two nodes are linked if their sets' resemblance
    is `similarity` or more, and a root is the smallest node of a component of those links.

    First, nodes whose SimHash fingerprints link() are compared by their whole sets, which joins most copies. A pair at
    the similarity may differ in more bits than the covering family's radius, though, and a link between fingerprints
    may stand for pairs that weren't compared. So what is still in different components is searched exactly: in any one
    order of all shingles, two such sets share one among each one's first n - ceil(similarity * n) + 1, n being its size
    (the prefix filter), and the first that they share leaves enough after it in both to reach the similarity. The order
    is that of the hashes, with frequent shingles last, so that the shingles of a common passage hardly ever meet.

    Of the nodes that meet in a shingle one is the hub, another in each turn, and each node is compared with the hub that
    it meets most; turns go on while the pairs left are more than the rows. After that all pairs of different components
    are compared that may reach the similarity by where and how often they meet first, as no more shingles than those from
    there on are shared, and by the parities of their sets. Places and parities are asked in the join, so that a pair that
    can't make it makes hardly any rows.
    Of the nodes of a shingle those of its largest component don't meet each other, so a large group of copies costs no
    square; what is left of one are pairs of different components whose resemblance is a little below the similarity.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, size))
    parities = [f"odd{i}" for i in range(PARITIES // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for b in batches:
            nodes, prints, sizes, prefixes, odd = [], [], [], [], []
            for t in _texts(b, 2):
                s = shingle_set(t, size)
                nodes.append(_node(s))
                prints.append(majority(s))
                sizes.append(len(s))
                odd.append(_parities(s))
                if len(late):
                    last = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                    s = np.append(s[~last], s[last])
                prefixes.append(s[: sizes[-1] - math.ceil(similarity * sizes[-1] - 1e-9) + 1].view(np.int64))
            uids = np.frombuffer(os.urandom(8 * len(nodes)), np.int64)
            arrays = [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(uids), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64()))]
            arrays += [pa.array(x) for x in np.array(odd, np.int64).reshape(-1, len(parities)).T]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "node", "fp", "uid", "n", "prefix", *parities])

    key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_key")
    rows = docs.select("doc_id", key, "text").mapInArrow(run, ", ".join(["doc_id long, text_key string, node long, fp long, uid long, n int, prefix array<long>", *[f"{p} long" for p in parities]]))
    rows = common.written(rows, "prefixes")

    # The fingerprints' links: each node with the first one of its fingerprint, and these with each other.
    once = F.struct(F.count(F.lit(1)).alias("c"), F.min("uid").alias("own"))
    each = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "n", *parities)], once.alias("rows"))  # a node has one fp, n and set
    nodes = common.written(each, "nodes")
    heads = common.written(nodes.groupBy("fp").agg(F.min_by(F.struct("node", "n"), "node").alias("h")).select("fp", "h.*"), "heads")
    alike = F.least("nx", "ny") >= similarity * F.greatest("nx", "ny") - 1e-6
    stars = nodes.join(heads.select("fp", F.col("node").alias("x"), F.col("n").alias("nx")), "fp").where("node <> x").select("x", F.col("node").alias("y"), "nx", F.col("n").alias("ny"))
    linked = links(heads.select("fp"))
    linked = linked.join(heads.selectExpr("fp a", "node x", "n nx"), "a").join(heads.selectExpr("fp b", "node y", "n ny"), "b").select("x", "y", "nx", "ny")
    pairs = stars.unionByName(linked).where(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    tried = common.written(pairs, "tried")
    found, _ = _resembling(docs, rows, tried, similarity, size)
    roots = common.written(components(found), "roots")
    common.discard(found, heads)

    # All rows of a node but one are left out; there are few, so prefixes needn't move for it.
    again = nodes.where("rows.c > 1").select("node", "rows.own")
    extra, seen = common.measured(rows.select("node", "uid").join(again, "node").where("uid <> own").select("node", "uid"), "extra", F.count(F.lit(1)).alias("n"))
    extra = F.broadcast(extra) if seen["n"] <= BROADCAST_ROWS else extra
    each = rows.join(extra, ["node", "uid"], "left_anti").select("node", "n", F.posexplode("prefix").alias("at", "h")).repartition("h")
    # Both sides read one exchange, as both need all columns.
    shared = each.groupBy("h").agg(F.count("*").alias("c"), F.max(F.struct("node", "n", "at")).alias("m")).where("c > 1").select("h")
    members = common.written(each.join(shared, "h"), "members")

    share = similarity / (1 + similarity)  # of both sizes together, that must be shared
    for turn in range(MAX_TURNS + 1):
        named = members.select("h", "node", "n", "at").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).repartition("h")
        hub = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "n", "at", "root")).alias("hub")
        hubs = named.groupBy("h").agg(hub, F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("h", "hub")
        left, seen = common.measured(named.join(hubs, "h"), "members-left", F.count(F.lit(1)).alias("n"))
        common.discard(members)
        members = left  # what meets its own component alone needs no more search
        if not seen["n"]:
            break
        largest = left.groupBy("h", "root").agg(F.count("*").alias("c"), F.min("n").alias("low")).groupBy("h")
        largest = largest.agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.min("low").alias("low"), F.sum("c").alias("m"), F.max("c").alias("c"))
        largest, squares = common.measured(largest, "largest", F.sum(F.col("m").cast("double") * (F.col("m") - F.col("c"))).alias("n"))
        last = turn == MAX_TURNS or (turn >= 1 and squares["n"] <= seen["n"])
        if not last:
            star = left.where("root <> hub.root").selectExpr("hub.node x", "node y", "hub.n nx", "n ny", "hub.at ax", "at ay").where(alike)
            need = share * (F.col("nx") + F.col("ny")) - 1e-6
            counted = star.groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("c"), F.max(F.least(F.col("nx") - F.col("ax"), F.col("ny") - F.col("ay"))).alias("after"))
            beyond = F.ceil(similarity * F.greatest("nx", "ny") - 1e-9) - 1  # shared shingles beyond the prefix that ends first
            pairs = counted.where((F.col("after") >= need) & (F.col("c") + beyond >= need)).groupBy("y").agg(F.max_by("x", F.struct("c", "x")).alias("x"))
        else:
            def place(m: Column, n: Column) -> tuple[Column, Column]:
                """What must be left from a shared shingle on in both sets of m and n, and how many such are shared at least."""
                need = F.ceil(share * (m + n) - 1e-6)
                left_on = F.greatest(need - (MEETINGS - 1), F.ceil(similarity * F.greatest(m, n) - 1e-9))
                return left_on, need - left_on + 1

            # A row takes part if its place would do for the smallest set that it may be compared with.
            first = left.drop("hub").join(largest.select("h", "major", "low"), "h")
            first = first.where(F.col("n") - F.col("at") >= place(F.col("n"), F.greatest(F.col("low"), similarity * F.col("n")))[0])
            sided = first.select("h", "node", "n", "at", "root", (F.col("root") != F.col("major")).alias("minor"))
            sided = common.written(sided.join(nodes.select("node", *parities), "node"), "members-sided")
            x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
            left_on, times = place(x("n"), y("n"))
            turned = sum((F.bit_count(x(p).bitwiseXOR(y(p))) for p in parities), F.lit(0))
            both = sided.alias("x").join(sided.where("minor").alias("y"), "h").where("x.root <> y.root and (not x.minor or x.node < y.node)")
            both = both.where(F.least(x("n") - x("at"), y("n") - y("at")) >= left_on)
            both = both.where(F.least(x("n"), y("n")) >= similarity * F.greatest(x("n"), y("n")) - 1e-6).where(turned <= (1 - 2 * share) * (x("n") + y("n")) + 1e-6)
            pairs = both.select(x("node").alias("x"), y("node").alias("y"), times.alias("times")).groupBy("x", "y", "times").count().where("count >= times")
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs, seen = common.measured(pairs, "pairs", F.count(F.lit(1)).alias("n"))
        common.discard(largest, *([sided] if last else []))
        if seen["n"]:
            found, seen = _resembling(docs, rows, pairs, similarity, size)
            tried = tried.unionByName(pairs)
            if seen["n"]:
                # Components so far are stars, so the new links join them in a few rounds.
                before = roots
                roots = common.written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)), "roots")
                common.discard(before)
            common.discard(found)
        if last:
            break
    common.discard(members)
    return rows.select("doc_id", "text_key", "node"), roots


def _resembling(docs: DataFrame, rows: DataFrame, pairs: DataFrame, similarity: float, size: int) -> tuple[DataFrame, dict]:
    """(a, b): the pairs of nodes whose whole shingle sets reach the similarity, as a table, and their number `n`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, size) for t in _texts(b, 0)]
            arrays = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "s"])

    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    one = F.min(F.struct("text_key", F.coalesce("doc_id", F.lit(0)).alias("id"))).alias("one")
    keys = rows.join(asked, "node", "left_semi").groupBy("node").agg(one).select(F.col("one.text_key").alias("__key"), F.col("one.id").alias("__id"))
    keys, seen = common.measured(keys, "keys", F.count(F.lit(1)).alias("n"))
    few = F.broadcast(keys) if seen["n"] <= BROADCAST_ROWS else keys
    texts = docs.select("text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("__key"), F.coalesce("doc_id", F.lit(0)).alias("__id"))
    sets = texts.join(few, ["__key", "__id"], "left_semi").select("text").mapInArrow(run, "node long, s array<long>")
    table, have = common.measured(sets, "shingles", F.count(F.lit(1)).alias("n"))
    sets = table.dropDuplicates(["node"]) if have["n"] > seen["n"] else table  # rows that repeat
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sx")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sy")), "b")
    same = F.size(F.array_intersect("sx", "sy"))
    both = both.where(same >= similarity * (F.size("sx") + F.size("sy") - same)).select("a", "b")
    found = common.measured(both, "found", F.count(F.lit(1)).alias("n"))
    common.discard(keys, table)
    return found


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each group of exact and near copies: that of its smallest doc_id.

    A document is a doc_id with a text: where a doc_id repeats with other texts, each is judged by itself, and of rows
    that repeat with both, one stays. A row without a doc_id stays only where no row of its group has one, and then one.
    """
    rows, roots = near_copies(docs)
    rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    gone = rows.join(best, "root").where(~same).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__gone")).distinct()
    gone = common.written(gone, "copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    # Whole rows travel as one column, so that no name of theirs meets one of these.
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("key"))
    kept = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__gone")), "left_anti")
    if rows.groupBy("doc_id", "text_key").count().where("count > 1").take(1):
        kept = kept.dropDuplicates(["doc_id", "key"])
    return kept.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classes(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
