"""Shards by balanced label propagation.

Documents with equal texts are linked through their group. Each starts in a shard of its hash; in every round documents
move to the shard where most of their group is, among those with room for it, as far as that shard's quota lets them in, largest first. Rounds
end when nothing moves, or after `rounds`, which cuts more groups than need be but breaks no law. What is above a quota
leaves in the order of its groups, and goes, group after group, to shards with room, so only groups that meet a full
shard are cut. Documents without links then fill what is left, large ones first, where the bytes are fewest: so counts
differ by one at most (law `rows`), and bytes are as even as the linked documents leave them.

Rounds, quotas and cuts work on one row for each group and shard, not on documents: what moves is a number of a group's
documents. Documents get a place within their group and first shard, by many tasks for a hot group, and from that place all else.

Results: null text has size 1 and crc32 0 and is linked with other null or empty texts. Repeated rows are documents of
their own, told apart by nothing, and so are interchangeable. A null doc_id is a document. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm import common


#: Groups, or blocks of them, of about 100 bytes each that are broadcast; beyond it they are joined by shuffle.
BROADCAST_GROUPS = 200_000


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def propagated(blocks: DataFrame, n_shards: int, quota: list[int], rounds: int) -> DataFrame:
    """group, src, n -> group, src, dst, n: how many of the group's documents that began in src end in dst.

    blocks: the documents of each linked group by their first shard.
    """

    def held(cut: DataFrame) -> tuple[DataFrame, dict[int, int]]:
        """`cut` as a table and its documents by shard, by one job."""
        cut, seen = common.measured(cut, "cut", *[F.sum(F.when(F.col("dst") == i, F.col("n"))).alias(f"n{i}") for i in range(n_shards)])
        return cut, {i: seen[f"n{i}"] or 0 for i in range(n_shards)}

    cut, load = held(blocks.withColumn("dst", F.col("src")))
    for _ in range(rounds):
        # Where most of the group is, among shards with room for the rest of it if there are any; then the lower shard.
        rooms = F.array(*[F.lit(max(0, quota[i] - load.get(i, 0))).cast("long") for i in range(n_shards)])
        here = cut.groupBy("grp", "dst").agg(F.sum("n").alias("w"))
        here = here.join(here.groupBy("grp").agg(F.sum("w").alias("of")), "grp")
        rank = F.struct((F.col("of") - F.col("w") <= F.get(rooms, F.col("dst"))).alias("fits"), "w", -F.col("dst"))
        goal = here.groupBy("grp").agg(F.max_by(F.struct(F.col("dst").alias("goal"), F.col("w").alias("gain")), rank).alias("g")).select("grp", "g.*")
        movers = cut.join(goal, "grp").withColumn("moves", F.col("dst") != F.col("goal"))
        asked = {(r["goal"], r["k"]): r["n"] for r in movers.where("moves").groupBy("goal", F.floor(F.log2("gain")).alias("k")).agg(F.sum("n").alias("n")).collect()}
        if not asked:
            break
        # Classes of gain enter whole while they fit, the next one in part by a hash; departures make room next round.
        share: dict[int, list] = {}
        for shard in range(n_shards):
            room, rules = max(0, quota[shard] - load.get(shard, 0)), []
            for k in sorted((k for g, k in asked if g == shard), reverse=True):
                take = min(1.0, room / asked[shard, k])
                rules.append((k, take))
                room -= int(take * asked[shard, k])
            share[shard] = rules
        part = F.lit(0.0)
        for shard, rules in share.items():
            for k, take in rules:
                part = F.when((F.col("goal") == shard) & (F.floor(F.log2("gain")) == k), F.lit(take)).otherwise(part)
        if not any(take > 0 for rules in share.values() for _, take in rules):
            break
        # A fraction of a block goes; blocks too small to be cut go whole or stay, by a hash.
        wish = F.col("n") * part
        luck = F.pmod(F.xxhash64("grp", "src", "dst"), F.lit(1 << 20)) / float(1 << 20)
        go = F.when(F.col("moves"), F.least(F.col("n"), F.floor(wish + luck).cast("long"))).otherwise(F.lit(0).cast("long"))
        moved = movers.withColumn("go", go)
        stay = moved.select("grp", "src", "dst", (F.col("n") - F.col("go")).alias("n"))
        gone = moved.select("grp", "src", F.col("goal").alias("dst"), F.col("go").alias("n"))
        cut, load = held(stay.unionByName(gone).where("n > 0").groupBy("grp", "src", "dst").agg(F.sum("n").alias("n")))
    return cut


def shard_documents(docs: DataFrame, n_shards: int = 8, *, rounds: int = 8, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    slim = docs.select(
        F.col("doc_id"),
        (F.octet_length(value) + 1).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        F.struct(F.xxhash64(value).alias("a"), F.hash(value).alias("b"), F.octet_length(value).alias("c")).alias("grp"),
    )
    slim = common.written(slim, "shard-keys")  # texts are read once
    total = slim.count()
    quota = [total // n_shards + (i < total % n_shards) for i in range(n_shards)]
    buckets = common.buckets_for(total)
    base = slim.withColumn("src", F.pmod(F.xxhash64(F.lit("start"), "doc_id"), F.lit(n_shards)).cast("int"))
    linked = base.groupBy("grp", "src").agg(F.count("*").alias("n"))
    # A hot group's documents stay where they are: the few groups go to them.
    several = _hinted(common.checkpointed(linked.groupBy("grp").agg(F.sum("n").alias("of")).where("of > 1").drop("of")))
    moves = propagated(linked.join(several, "grp"), n_shards, quota, rounds)

    # Of what goes to a shard, blocks stay in order of their groups while its quota lasts; dst is null for the rest.
    limit = F.element_at(F.array(*map(F.lit, quota)).cast("array<long>"), F.col("dst") + 1)
    before = _running(moves, ["dst"], F.col("n"), buckets)
    stays = F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), limit - F.col("before")))
    cut = before.withColumn("stays", stays)
    kept = cut.select("grp", "src", "dst", F.col("stays").alias("n")).where("n > 0")
    over = cut.select("grp", (F.col("n") - F.col("stays")).alias("n"), "src").where("n > 0").groupBy("grp", "src").agg(F.sum("n").alias("n"))
    over = common.checkpointed(over)
    held = {r["dst"]: r["n"] for r in kept.groupBy("dst").agg(F.sum("n").alias("n")).collect()}  # a row a shard
    room = [quota[i] - held.get(i, 0) for i in range(n_shards)]
    # The rest, one group after the other, fills the rooms one after the other, largest first.
    spill, edge = [], 0
    for i in sorted(range(n_shards), key=lambda i: (-room[i], i)):
        spill.append((edge, edge + room[i], i))
        edge += room[i]
    laid = _running(over.withColumn("all", F.lit(0)), ["all"], F.col("n"), buckets)
    parts = [F.struct(F.lit(i).alias("dst"), F.greatest(F.lit(0).cast("long"), F.least(F.col("before") + F.col("n"), F.lit(high)) - F.greatest(F.col("before"), F.lit(low))).alias("n")) for low, high, i in spill]
    again = laid.select("grp", "src", F.explode(F.array(*parts)).alias("p")).select("grp", "src", "p.dst", "p.n").where("n > 0")
    moves = common.checkpointed(kept.unionByName(again).groupBy("grp", "src", "dst").agg(F.sum("n").alias("n")))

    # Deal each block's documents to where the block went: the i-th of a (group, src) takes the span that holds i.
    spans = Window.partitionBy("grp", "src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)
    moves = moves.withColumn("from", F.coalesce(F.sum("n").over(spans), F.lit(0))).withColumn("to", F.col("from") + F.col("n"))
    moves = common.checkpointed(moves.groupBy("grp", "src").agg(F.sort_array(F.collect_list(F.struct("from", "to", "dst"))).alias("spans")))  # at most one a shard
    moves = _hinted(moves)
    spread = F.abs(F.hash("doc_id").cast("long"))
    members = common.with_slots(base.join(moves.select("grp", "src"), ["grp", "src"], "left_semi"), ["grp", "src"], [F.col("doc_id")], spread, buckets, "i")
    fits = F.filter("spans", lambda s: (s["from"] <= F.col("i")) & (F.col("i") < s["to"]))
    labelled = members.join(moves, ["grp", "src"]).select("doc_id", "size", "text_crc32", "grp", F.element_at(fits, 1)["dst"].alias("shard"))
    labelled = common.checkpointed(labelled)

    # Documents without links: a class of sizes at a time, to the shards with the fewest bytes that have room.
    loose = base.join(several, "grp", "left_anti").select("doc_id", "size", "text_crc32", "grp").withColumn("class", F.floor(F.log2("size") * 4).cast("int"))
    counts = loose.groupBy("class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()  # some 4 for each doubling of sizes
    own = {r["shard"]: r for r in labelled.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()}
    room = [quota[i] - (own[i]["n"] if i in own else 0) for i in range(n_shards)]
    dealt = deal([(r["class"], r["n"], r["bytes"]) for r in counts], room, [own[i]["bytes"] if i in own else 0 for i in range(n_shards)])
    placed = common.with_slots(loose, ["class"], [F.col("doc_id"), F.col("grp")], spread, buckets, "place")
    shares = []
    for size_class, parts in dealt.items():
        at = 0
        for shard, n in parts:
            shares.append((size_class, at, at + n, shard))
            at += n
    shares = df_of(docs, shares, "class int, low long, high long, dst int").groupBy("class").agg(F.collect_list(F.struct("low", "high", "dst")).alias("shares"))
    mine = F.filter("shares", lambda x: (x["low"] <= F.col("place")) & (F.col("place") < x["high"]))
    placed = placed.join(F.broadcast(shares), "class").withColumn("shard", F.element_at(mine, 1)["dst"])  # a row a class
    whole = labelled.unionByName(placed.drop("place", "class", "shares"))
    whole = common.with_slots(whole, ["shard"], [F.col("doc_id"), F.col("grp")], spread, buckets, "slot")
    return whole.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def df_of(docs: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return docs.sparkSession.createDataFrame(rows, schema)


def _running(df: DataFrame, by: list[str], n: Column, buckets: int) -> DataFrame:
    """`df`, a row for each group and shard, with `before`: the sum of `n` over rows of the same `by` whose groups come first."""
    df = df.withColumn("__b", F.pmod(F.xxhash64("grp"), F.lit(buckets)).cast("int"))
    sums = df.groupBy(*by, "__b").agg(F.sum(n).alias("__s"))
    first = F.coalesce(F.sum("__s").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum(n).over(Window.partitionBy(*by, "__b").orderBy("grp", "src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = df.withColumn("__w", within)
    return ranked.join(sums.withColumn("__f", first).drop("__s"), [*by, "__b"]).withColumn("before", F.col("__f") + F.col("__w")).drop("__b", "__f", "__w")


def deal(classes: list[tuple[int, int, int]], room: list[int], held: list[int], pieces: int = 64) -> dict[int, list[tuple[int, int]]]:
    """class -> (shard, how many) in turn. classes: their number, documents and bytes; room: documents; held: bytes.

    From the largest sizes down, each piece of a class goes where the bytes are fewest among shards with room. Bytes are
    the class's mean, so the work is on numbers of documents, whatever their count.
    """
    room, held, out = list(room), [float(b) for b in held], {}
    for size_class, n, total in sorted(classes, reverse=True):
        shares: dict[int, int] = {}
        step, left = max(1, n // pieces), n
        while left:
            shard = min((i for i in range(len(room)) if room[i] > 0), key=lambda i: (held[i], i))
            take = min(step, left, room[shard])
            shares[shard] = shares.get(shard, 0) + take
            room[shard] -= take
            held[shard] += take * total / n
            left -= take
        out[size_class] = sorted(shares.items())
    return out


def cut_links(placed: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """groups, documents, cut_groups and cut_documents of linked texts: how many are in other shards than most of their group."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    of = docs.select("doc_id", F.sha2(value.cast("binary"), 256).alias("grp"))
    each = placed.select("doc_id", "shard").join(of, "doc_id").groupBy("grp", "shard").agg(F.count("*").alias("n"))
    each = each.groupBy("grp").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where("n > 1")
    return each.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("documents"), F.count_if(F.col("most") < F.col("n")).alias("cut_groups"), F.coalesce(F.sum(F.col("n") - F.col("most")), F.lit(0)).alias("cut_documents"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard_documents(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
