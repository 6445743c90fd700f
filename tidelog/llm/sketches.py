"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions.

A sketch is the k smallest distinct 64-bit hashes of a document's shingles of `size` words (fewer words: the whole
sequence; none: an empty sketch), ascending. Sketches of parts merge into that of the whole: the k smallest of both. Two
sketches estimate resemblance: among the k smallest of their union, the share that both hold. The k-th smallest hash
tells how many distinct shingles there are, and both together containment.

Results: null text counts as empty; two empty sketches resemble each other fully, an empty and another not at all.
Equal texts have equal sketches. Rows that repeat are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm import common

K, SIZE = 128, 5
#: Bytes of text that a range of documents holds about, and how many ranges there are at most.
RANGE_BYTES, MAX_RANGES = 128 << 20, 200_000
MAX_STEPS = MAX_RANGES.bit_length()
LONG_MAX = (1 << 63) - 1


def _shingler(size: int) -> Callable[[Column], Column]:
    return lambda at: F.xxhash64(*[F.get(F.col("__h"), at + j) for j in range(size)])


def with_sketch(df: DataFrame, text: str, out: str, *, k: int = K, size: int = SIZE) -> DataFrame:
    """`df` with the sketch of a text column."""
    cut = F.filter(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn("__h", F.transform(cut, lambda w: F.xxhash64(w))).withColumn("__n", F.size("__h"))
    several = F.transform(F.sequence(F.lit(0), F.greatest(F.col("__n") - size, F.lit(0))), _shingler(size))
    few = F.array(F.xxhash64("__h"))
    hashes = F.when(F.col("__n") >= size, several).when(F.col("__n") > 0, few).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop("__h", "__n")


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    both = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """How many distinct shingles: exact below k, else (k - 1) / the k-th smallest hash as a fraction of all."""
    part = (F.element_at(a, k).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / part)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The share of a's shingles that b has too."""
    j, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (n + m) / (1 + j) / n))


def as_text(a: Column) -> Column:
    """16 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def bucket_of(value: Column, bounds: Column) -> Column:
    """How many of `bounds`, an ascending array, are at most `value`, by halving."""
    powers = F.transform(F.sequence(F.lit(MAX_STEPS), F.lit(0)), lambda k: F.pow(F.lit(2), k).cast("int"))

    def step(at: Column, p: Column) -> Column:
        return F.when((at + p <= F.size(bounds)) & (F.get(bounds, at + p - 1) <= value), at + p).otherwise(at)

    return F.aggregate(powers, F.lit(0), step)


def with_next(df: DataFrame, key: str, tie: str, columns: list[str], n_buckets: int) -> DataFrame:
    """`df` with next_<column>: what the next row has, in descending order of `key`; after the last comes the first.

    Rows are dealt to ranges of key and tie, so no task sees more than a range, and a key that many rows have is several.
    The bounds are Spark's own, of a range partitioning of the keys alone. The first row of each range also travels to the
    range before it, where it is read but not put out. Nulls come last; equal keys go by `tie`; rows equal in both, which
    nothing tells apart, are in one range.
    """
    order = F.struct(F.coalesce(F.bitwise_not(F.col(key)), F.lit(LONG_MAX)).alias("o"), F.col(tie).alias("t"))
    df = df.withColumn("__o", order)
    ranges = df.select("__o.o", "__o.t").repartitionByRange(max(1, n_buckets), "o", "t").select(F.spark_partition_id().alias("b"), F.struct("o", "t").alias("s"))
    firsts = ranges.groupBy("b").agg(F.min("s").alias("s"))
    bounds = common.checkpointed(firsts.agg(F.slice(F.array_sort(F.collect_list("s")), 2, MAX_RANGES).alias("__bounds")))  # an entry a range
    df = df.crossJoin(F.broadcast(bounds)).withColumn("__b", bucket_of(F.col("__o"), F.col("__bounds"))).drop("__bounds")  # one row
    heads = common.checkpointed(df.groupBy("__b").agg(F.min("__o").alias("__h")))
    around = Window.orderBy("__b")  # a row a range
    before = F.coalesce(F.lag("__b").over(around), F.max("__b").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    df = df.join(F.broadcast(heads.withColumn("__to", before)), "__b")
    place = F.struct(F.col("__b").alias("b"), F.lit(False).alias("ghost"))
    places = F.when(F.col("__o") == F.col("__h"), F.array(place, F.struct(F.col("__to").alias("b"), F.lit(True).alias("ghost")))).otherwise(F.array(place))
    keep = [c for c in df.columns if not c.startswith("__")]
    df = df.select(*keep, "__o", F.explode_outer(places).alias("__p")).repartition(max(1, n_buckets), "__p.b")
    at = Window.partitionBy("__p.b").orderBy("__p.ghost", "__o")
    df = df.select(*keep, "__p", *[F.lead(c).over(at).alias(f"next_{c}") for c in columns])
    return df.where(~F.col("__p.ghost")).drop("__p")


def compared(docs: DataFrame, *, k: int = K, size: int = SIZE) -> DataFrame:
    """Each document's sketch against those of its edited text and of the next document, in descending order of doc_id."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = min(MAX_RANGES, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES)))
    df = with_sketch(df.withColumn("tie", F.xxhash64("text")), "text", "sketch", k=k, size=size)
    df = with_next(df, "doc_id", "tie", ["text", "sketch"], n_buckets)
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    df = df.withColumn("edited", edited).withColumn("n_chars", n.cast("long")).drop("text", "next_text")
    df = with_sketch(df.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), "edited", "edited_sketch", k=k, size=size)
    return df.drop("edited", "tie")


def query(spark, sf_dir: str) -> DataFrame:
    df = compared(common.table(spark, sf_dir, "documents"))
    return df.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
