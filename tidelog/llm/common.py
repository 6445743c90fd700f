"""What the operators of this subpackage share: sessions, keys, global prefix sums."""

from __future__ import annotations

import gc
import itertools
import os
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that one Arrow batch may hold; bounds a Python worker's memory.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2048

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a session on one machine without one gets a local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file:///tmp/checkpoints/{os.getpid()}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: After so many tables the driver's garbage is collected.
TIDY_EVERY = 3
_tables = itertools.count(1)


def _tidy(spark: SparkSession) -> None:
    """Now and then let Spark drop what steps that are over have left.

    Shuffle files and broadcasts go when the driver finds their handles to be garbage, which a driver with room to spare
    doesn't look for in a long row of small jobs.
    """
    if next(_tables) % TIDY_EVERY == 0:
        gc.collect()
        spark._jvm.System.gc()
        trimmed(spark)


def trimmed(spark: SparkSession) -> bool:
    """Have the driver's JVM give freed native memory (of compilers and buffers) back to the system; whether it could.

    Its allocator keeps that for each thread, which adds up to hundreds of MB over many jobs. JVMs before 17.0.9 and
    those on other systems than Linux don't know the command.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        kinds, words = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        names = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        for i, name in enumerate(names):
            kinds[i] = jvm.java.lang.Class.forName(name)
        words[0], words[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # By the interface: the server's own class isn't open to reflection.
        call = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), words)
    except Py4JError:
        return False
    return True


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder; later jobs don't depend on its lineage."""
    shared = shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared)
    out = df.checkpoint(eager=True)
    _tidy(df.sparkSession)
    return out


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    _tidy(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() or measured() that nothing reads any more: what was made from them must be written, too."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def measured(df: DataFrame, what: str, *totals: Column) -> tuple[DataFrame, dict]:
    """`df` as a Parquet table in the shared folder, and totals of its rows, by one job. A retry may count rows twice."""
    seen = Observation()
    return written(df.observe(seen, *totals), what), seen.get


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. lower() is taken where every character is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def id_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo `n`; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def thinned(df: DataFrame, group: str, most: int, key: Column) -> DataFrame:
    """About `most` rows of each group, all of a smaller one: those whose hash of `key` is low, each key once.

    Only counts, a row a group, are gathered; no group is ranked or brought together. Where `most` asks for a part of a
    group, what comes is binomial around it, so bounds that follow from it hold but for a few standard deviations.
    """
    keyed = df.withColumn("__u", F.xxhash64(F.lit("sample"), key))
    counts = checkpointed(keyed.groupBy(group).agg(F.approx_count_distinct("__u").alias("__c")))
    few = counts.count() <= 100_000  # a row a group
    near = keyed.join(F.broadcast(counts) if few else counts, group)
    near = near.where(F.col("__u") / float(1 << 64) + 0.5 <= most / F.col("__c")).drop("__c")
    return near.dropDuplicates([group, "__u"]).drop("__u")  # of the sample only


def buckets_for(rows: int, per_bucket: int = 50_000, least: int = 64, most: int = 65_536) -> int:
    """How many buckets keep each near `per_bucket` rows."""
    return max(least, min(most, -(-rows // per_bucket)))


def with_slots(df: DataFrame, group: Sequence[str], order: Sequence[Column], spread: Column, n_buckets: int, out: str) -> DataFrame:
    """`out`: each row's place in its `group`, from 0 without gaps, in two levels.

    Rows are dealt to `n_buckets` buckets of a group by `spread` (a non-negative long), so that a group with a third of
    all rows is ranked by many tasks. Places ascend by bucket, then by `order`; only counts of buckets meet in one
    place. `order` must be total within a bucket but for rows that are equal throughout.
    """
    b = "__bucket"
    df = df.withColumn(b, F.pmod(spread, F.lit(n_buckets)).cast("int"))
    sizes = df.groupBy(*group, b).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy(*group, b).orderBy(*order)) - 1
    ranked = df.withColumn("__within", within.cast("long")).alias("r")
    starts = starts.alias("s")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*group, b)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return ranked.join(starts, on).select("r.*", (F.col("__start") + F.col("__within")).alias(out)).drop(b, "__within")
