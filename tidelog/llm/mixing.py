"""Mix sources to target weights by capped water-filling.

Every source has a weight; targets share the corpus's words by weight, and no target may exceed `max_epochs` times its
source's words. A source above that is clamped there and its excess goes to the others by weight, until none is above:
target = min(cap, level * weight) for one level. Whole repetitions of a source are taken in full; the fraction that is
left is filled with whole documents in a seeded order while they fit, and then with the one document among the rest
whose size comes nearest to the gap, if that makes it smaller.

The seeded order makes the choice a comparison: a document is in the fraction if its place is not after its source's border.
Sums of buckets of the order find the bucket that holds the border, only that bucket's rows are ranked, and the borders, a row
a source, go to the documents, whose texts are never shuffled.

Results: null text has size 0; a null source is a source of its own, after all others; documents without words are taken
0 words; an empty table gives an empty result. Rows that are equal in doc_id and text have one place in the order and are
taken alike. Sources with equal text are one. Runs agree, as the order is a hash of the document. All columns of the documents
are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm import common

#: Rows of a bucket of a source's order about, and how many bits number buckets at most.
BUCKET_ROWS, MAX_BITS = 2_000, 20
#: Sources, rows of about 150 bytes, that are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """How many runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, max_epochs: int) -> DataFrame:
    """source, source_size, weight -> the same with `target`.

    A level rises over sources in the order in which they reach their caps, so one pass over sorted sources finds where
    it stops. One row a source: their number, not the corpus's, meets in the window.
    """
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("weight").asc(), F.col("source").asc_nulls_last())
    below = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.col("total") - F.col("clamped")) / F.col("open_weight")
    steps = (
        sizes.withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("clamped", F.coalesce(F.sum("cap").over(below), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(rest))
        .withColumn("level", F.when(level <= F.col("cap") / F.col("weight"), level))
        # The first step at which no open source is above its cap; from there on the levels of later steps only sink.
        .withColumn("found", F.max("level").over(whole))
    )
    filled = F.least(F.col("cap").cast("double"), F.col("found") * F.col("weight"))
    return steps.select("source", "source_size", "weight", F.coalesce(filled, F.col("cap").cast("double")).alias("target"))


def sized(docs: DataFrame, *, seed: int = 9) -> DataFrame:
    """row, the whole document, with what the mix decides by: doc_id, source, size and order, 16 hexadecimal digits."""
    text = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    place = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    order = F.substring(F.md5(place.cast("binary")), 1, 16)
    return docs.select(F.struct("*").alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"), order.alias("order"))


def borders(slim: DataFrame, max_epochs: int) -> DataFrame:
    """A row a source: its size and target, how often it is taken whole, the border of the fraction, and what fills the gap.

    slim: doc_id, source, size, order, a table, as it is read several times.
    """
    bits = max(0, min(MAX_BITS, (slim.count() // BUCKET_ROWS).bit_length()))
    slim = slim.withColumn("bucket", F.shiftright(F.conv(F.substring("order", 1, 6), 16, 10).cast("long"), 24 - bits))
    parts = common.checkpointed(slim.groupBy("source", "bucket").agg(F.sum("size").alias("n")))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    sizes = parts.groupBy("source").agg(F.sum("n").alias("source_size")).withColumn("weight", ((F.row_number().over(place) - 1) % 3 + 1).cast("long"))
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    goals = targets(sizes, max_epochs).withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    goals = common.checkpointed(goals.withColumnRenamed("source", "s").drop("weight"))
    mine = F.col("source").eqNullSafe(F.col("s"))
    goals = _hinted(goals)

    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    edge = starts.join(goals, mine).where("start <= left and left < start + n").select("s", F.col("bucket").alias("edge"), "start", "left")
    edge = _hinted(common.checkpointed(edge))  # a row a source
    # Documents in the order; ones with the same place share their end.
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("order", F.col("doc_id").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = slim.join(edge, mine & (F.col("bucket") == F.col("edge"))).withColumn("end", F.col("start") + upto)
    last = ranked.where("end <= left").groupBy("s").agg(F.max(F.struct("order", "doc_id")).alias("border"), F.max("end").alias("end"))
    edges = edge.alias("e").join(last.alias("l"), F.col("e.s").eqNullSafe(F.col("l.s")), "left")
    # Where nothing of the bucket fits, the border lies before it.
    edges = edges.select("e.s", "edge", "border", (F.col("left") - F.coalesce(F.col("l.end"), F.col("start"))).alias("gap"))
    edges = _hinted(common.checkpointed(edges))

    rest = slim.join(edges, mine).where(~_inside() & (F.col("size") > 0))
    off = F.abs(F.col("size") - F.col("gap"))
    near = rest.where(off < F.col("gap")).groupBy("s").agg(F.min(F.struct(off.alias("off"), "order", "doc_id")).alias("b"), F.first("gap").alias("gap"))
    near = _hinted(common.checkpointed(near))
    # If that document is there several times, all of them come, and only if that makes the gap smaller.
    same = F.struct("order", "doc_id").eqNullSafe(F.struct("b.order", "b.doc_id"))
    fill = slim.join(near, mine).where(same).groupBy("s").agg(F.sum("size").alias("n"), F.first("gap").alias("gap"), F.first(F.struct("b.order", "b.doc_id")).alias("fill"))
    fill = fill.where(F.abs(F.col("n") - F.col("gap")) < F.col("gap")).select("s", "fill")
    out = goals.alias("g").join(edges.alias("e"), F.col("g.s").eqNullSafe(F.col("e.s")), "left").join(fill.alias("f"), F.col("g.s").eqNullSafe(F.col("f.s")), "left")
    return common.checkpointed(out.select("g.s", "source_size", "target", "whole", "edge", "border", "fill", F.lit(bits).alias("bits")))


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _inside() -> Column:
    """Whether a row of slim lies in its source's fraction: before the bucket of the border, or not after the border."""
    return (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & F.coalesce(F.struct("order", "doc_id") <= F.col("border"), F.lit(False)))


def mix(docs: DataFrame, *, max_epochs: int = 3, slim: DataFrame | None = None) -> DataFrame:
    """sized() documents: row, doc_id, source, size, source_size, target and `repeats`, how often the mix takes each document.

    slim: the same rows without `row`, as a table; it is written if it isn't given, so that texts are read once more only.
    """
    if slim is None:
        slim = common.written(docs.drop("row"), "sizes")
    edges = borders(slim, max_epochs)
    joined = docs.join(_hinted(edges), F.col("source").eqNullSafe(F.col("s"))).withColumn("bucket", F.expr("shiftright(cast(conv(substring(order, 1, 6), 16, 10) as bigint), 24 - bits)"))
    filled = F.coalesce(F.struct("order", "doc_id").eqNullSafe(F.col("fill")) & F.col("fill").isNotNull(), F.lit(False))
    extra = (F.col("size") > 0) & (F.coalesce(_inside(), F.lit(False)) | filled)
    kept = [c for c in docs.columns if c != "order"]
    return joined.select(*kept, "source_size", "target", (F.col("whole") + extra.cast("long")).alias("repeats"))


def resampled(docs: DataFrame, *, max_epochs: int = 3, seed: int = 9) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns."""
    mixed = mix(sized(docs, seed=seed), max_epochs=max_epochs).where("repeats > 0")
    return mixed.select("row", F.explode(F.expr("sequence(1L, repeats)"))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    # Sizes and places are written once; the texts are read once.
    docs = common.written(sized(common.table(spark, sf_dir, "documents")).drop("row"), "sizes")
    return mix(docs, slim=docs).select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"))


ORACLE = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         substr(md5('9:' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(md5(text), '')), 1, 16) as ord from documents),
s as (select source, cast(sum(size) as bigint) as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from d group by source),
c as (select *, source_size * 3 as cap, cast(sum(source_size) over () as bigint) as total,
             cast(coalesce(sum(source_size * 3) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as clamped,
             cast(sum(weight) over (w rows between current row and unbounded following) as bigint) as open_weight
      from s window w as (order by source_size * 3 / weight, weight, source nulls last)),
l as (select *, max(case when (total - clamped) / open_weight <= cap / weight then (total - clamped) / open_weight end) over () as found from c),
t as (select source, source_size, coalesce(least(cast(cap as double), found * weight), cast(cap as double)) as target from l),
g as (select *, cast(floor(target / greatest(source_size, 1)) as bigint) as whole from t),
p as (select d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size as rest,
             cast(sum(d.size) over (partition by d.source order by d.ord, d.doc_id nulls first range between unbounded preceding and current row) as bigint) as upto
      from d join g on d.source is not distinct from g.source),
e as (select source, max(rest) - coalesce(max(upto) filter (upto <= rest), 0) as gap from p group by source),
b as (select p.source, arg_min(struct_pack(o := p.ord, i := p.doc_id), struct_pack(off := abs(p.size - e.gap), o := p.ord, i := p.doc_id)) as pick, max(e.gap) as gap
      from p join e on p.source is not distinct from e.source where p.upto > p.rest and p.size > 0 and abs(p.size - e.gap) < e.gap group by p.source),
f as (select b.source, b.pick from b join p on p.source is not distinct from b.source and p.ord = b.pick.o and p.doc_id is not distinct from b.pick.i
      group by b.source, b.pick, b.gap having abs(sum(p.size) - b.gap) < b.gap)
select p.doc_id, p.size, p.source_size, p.target,
       cast(p.size * (p.whole + case when p.size > 0 and (p.upto <= p.rest or (f.pick is not null and p.ord = f.pick.o and p.doc_id is not distinct from f.pick.i)) then 1 else 0 end) as bigint) as taken
from p left join f on p.source is not distinct from f.source
"""
