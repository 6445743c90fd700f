"""Connected components of a link table, by min-label rounds with shortcuts, all in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common


def components(links: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(a, b) links of longs -> (node, root): each linked node and the smallest node that it reaches.

    Alternates large-star and small-star steps (Kiveris et al.): every node hangs its larger neighbours, then its
    smaller ones, under the smallest of them. The links end as stars in about log(n) rounds, and a node's neighbours
    are aggregated, never listed.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges, mark = _marked(edges)
    for k in range(max_rounds + 1):
        if not mark[0]:
            break
        if k == max_rounds:
            raise RuntimeError(f"components aren't done after {max_rounds} rounds")
        # Large star: neighbours above a node hang under the smallest of its neighbourhood.
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: neighbours below a node, and itself, hang under the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        before = edges
        edges, now = _marked(small.where("a <> b").distinct())
        common.discard(before)
        if now == mark:
            break
        mark = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(edges.select(b.alias("node"), b.alias("root")).distinct())


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a table, and what changes whenever they do: their number and a hash sum."""
    total = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
    edges, seen = common.measured(edges, "links", F.count(F.lit(1)).alias("n"), total.alias("s"))
    return edges, (seen["n"], seen["s"])
