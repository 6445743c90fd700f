"""Benchmark decontamination with DataFrame functions only.

Item texts and documents are cut in words the same way. Windows of `size` consecutive item words (a shorter item is
one window) form a set keyed by hash, which is broadcast while it is small (checked) and shuffled beyond. Each
document gives one hash for each window of a length that items have; those that meet the set are verified against the
window's words, and a document's hits come together as word positions, whose union is measured.

A document's own row travels among its window hashes as one that matches nothing, so texts are read and cut once. While
the set is broadcast, hits are verified where they are found. Beyond that only hashes and positions are shuffled, no
words; what meets comes together by document and is verified by one join with the words of the documents that have any.

Results: null text and texts without words give zeros. A window that several items share counts for each. Rows that
repeat are kept, each with the same result. Items without words never match. Without items nothing is hit. Rows of
equal doc_id and different text stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

SIZE = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows that are broadcast at most, and bytes of their words.
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 64 << 20


def words(text: Column) -> Column:
    """Words of a text in order, A-Z lower-cased."""
    cut = F.split(common.lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(cut, lambda w: w != "")  # only the first and the last can be empty


def window_hash(hashes: Column, at: Column, *, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(hashes, at + k) for k in range(size)])


def hasher(size: int) -> Callable[[Column], Column]:
    return lambda at: window_hash(F.col("h"), at, size=size)


def spans(n: Column, size: int) -> Column:
    """0 .. n - size, or nothing."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """item_id, len, words: each item's windows as their words joined by a space."""
    cut = items.select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    cut = cut.withColumn("len", F.least("n", F.lit(size)))
    each = cut.select("item_id", "len", "w", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("len"))).alias("at"))
    return each.select("item_id", "len", F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " ").alias("words")).distinct()


def hits(docs: DataFrame, by_hash: DataFrame, lengths: list[int], few: bool, *, text: str = "text") -> DataFrame:
    """doc_id, text_hash, n, self, at, len, window of each window met, and a row with self = 1 for each row of `docs`.

    few: `by_hash` is broadcast and hits are verified here; else rows have `words`, those of the window, to verify by.
    """
    plain = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    cut = plain.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    cut = cut.withColumn("h", F.transform("w", lambda w: F.xxhash64(w))).withColumn("n", F.size("w"))
    # Entry 0 is the document itself, spread by its key; the windows of each length follow in order of their first word.
    rows = [F.array(F.xxhash64(F.lit("self"), "doc_id", "text_hash"))]
    for k in lengths:
        rows.append(F.transform(spans(F.col("n"), k), hasher(k)))
    carried = ["w"] if few else []
    listed = cut.select("doc_id", "text_hash", *carried, "n", F.concat(*rows).alias("hashes"))
    # The outer form, as for the other Spark would first test each list for rows, and compute it once more to do so.
    probes = listed.select("doc_id", "text_hash", "n", *carried, F.posexplode_outer("hashes").alias("p", "hash"))
    window_set = F.broadcast(by_hash) if few else by_hash.hint("shuffle_hash")
    met = probes.alias("a").join(window_set.alias("b"), (F.col("a.hash") == F.col("b.hash")) & (F.col("p") > 0), "left").where("p = 0 or len is not null")
    # p - 1 counts windows over all lengths before this one.
    before = F.lit(0)
    for k in reversed(lengths):
        shorter = [x for x in lengths if x < k]
        skipped = sum((F.greatest(F.col("n") - x + 1, F.lit(0)) for x in shorter), F.lit(0))
        before = F.when(F.col("len") == k, skipped).otherwise(before)
    at = F.col("p") - 1 - before
    if few:
        same = F.array_join(F.slice("w", F.greatest(at, F.lit(0)) + 1, F.coalesce("len", F.lit(1))), " ") == F.col("words")
        met = met.where((F.col("p") == 0) | same)
    own = ["doc_id", "text_hash", "n", (F.col("p") == 0).cast("int").alias("self"), at.alias("at"), "len", "window"]
    return met.select(*own, *([] if few else ["words"]))


def _verified(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """`found` with those of `met` whose words are in the text at their place."""
    some = found.where("size(met) > 0")
    same_row = F.col("f.doc_id").eqNullSafe(F.col("d.__id")) & (F.col("f.text_hash") == F.col("d.__hash"))
    value = F.col(f"`{text}`")
    texts = docs.select(F.col("doc_id").alias("__id"), F.xxhash64(value).alias("__hash"), value.alias("__text"))
    both = some.alias("f").join(texts.alias("d"), same_row).dropDuplicates(["doc_id", "text_hash"])
    w = words(F.col("__text"))
    true = F.filter("met", lambda m: F.array_join(F.slice(F.col("__w"), m["at"] + 1, m["len"]), " ") == m["words"])
    checked = both.withColumn("__w", w).select("f.doc_id", "f.text_hash", "f.n", "f.copies", true.alias("met"))
    return checked.unionByName(found.where("size(met) = 0"))


def annotate(docs: DataFrame, items: DataFrame, *, text: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated of each row of `docs`."""
    each = common.checkpointed(item_windows(items, size))
    lengths = sorted(r["len"] for r in each.select("len").distinct().collect())  # `size` values at most
    by_window = each.select("len", "words").distinct()
    cut_again = F.split("words", " ")
    by_hash = by_window.select(
        "len", "words", F.xxhash64("len", "words").alias("window"), F.transform(cut_again, lambda w: F.xxhash64(w)).alias("h")
    )
    pick = F.lit(None).cast("long")
    for k in lengths:
        pick = F.when(F.col("len") == k, window_hash(F.col("h"), F.lit(0), size=k)).otherwise(pick)
    by_hash = common.checkpointed(by_hash.withColumn("hash", pick).select("hash", "len", "words", "window"))
    told = each.agg(F.count("*").alias("n"), F.sum(F.octet_length("words")).alias("b")).first()  # with one row for each item that has the window
    few = told["n"] <= BROADCAST_WINDOWS and (told["b"] or 0) <= BROADCAST_BYTES

    met = hits(docs, by_hash, lengths, few, text=text)
    # The union of [at, at + len) in order of position; a document's hits are at most its words times the lengths.
    more = [] if few else ["words"]
    one = F.when(F.col("self") == 0, F.struct("at", "len", "window", *more))
    found = met.groupBy("doc_id", "text_hash", "n").agg(F.sum("self").alias("copies"), F.sort_array(F.collect_set(one)).alias("met"))
    if not few:
        found = _verified(common.written(found, "contamination-met"), docs, text)
    spans = F.transform("met", lambda m: F.struct(m["at"].alias("at"), m["len"].alias("len")))
    found = found.select("doc_id", "text_hash", "n", "copies", F.array_sort(F.array_distinct(spans)).alias("spans"), F.array_distinct(F.col("met.window")).alias("windows"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))

    def add(acc: Column, s: Column) -> Column:
        end = s["at"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["hit"] + F.greatest(end - F.greatest(s["at"], acc["end"]), F.lit(0))).alias("hit"))

    # Both the counts and the items come from here; the texts are scanned once.
    found = common.written(found, "contamination").withColumn("n_hit", F.aggregate("spans", start, add, lambda acc: acc["hit"]).cast("long"))
    ids = each.select(F.xxhash64("len", "words").alias("window"), F.col("item_id").cast("string").alias("item"))
    of = found.where("n_hit > 0").select("doc_id", "text_hash", F.explode("windows").alias("window"))
    of = of.join(F.broadcast(ids) if few else ids, "window").groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("items"))
    keys = F.col("f.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("f.text_hash") == F.col("o.text_hash"))
    both = found.alias("f").join(of.alias("o"), keys, "left").select("f.doc_id", "f.text_hash", "n", "n_hit", "copies", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return both.select(
        "doc_id", "text_hash", F.col("n").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.expr("sequence(1L, copies)")).alias("copy"),
    ).drop("copy")


def clean(docs: DataFrame, items: DataFrame, *, size: int = SIZE) -> DataFrame:
    """`docs` without those that hold a benchmark window."""
    bad = annotate(docs, items, size=size).where("contaminated").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    # Whole rows travel as one column, so that no name of theirs meets one of these.
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("key"))
    return keyed.join(bad, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("hash")), "left_anti").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")
    return annotate(docs, items).drop("text_hash")


ORACLE = r"""
with iw as (
  select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from benchmark),
il as (select item_id, w, least(len(w), 10) as k from iw where len(w) > 0),
win as (select distinct item_id, k, array_to_string(w[i + 1 : i + k], ' ') as s
        from (select item_id, w, k, unnest(range(0, len(w) - k + 1)) as i from il)),
dw as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') as w from documents),
ks as (select distinct k from win),
probe as (select doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') as s
          from (select doc_id, w, k, unnest(range(0, len(w) - k + 1)) as i from dw, ks where len(w) >= k)),
hit as (select p.doc_id, p.i, p.k, win.item_id from probe p join win on win.k = p.k and win.s = p.s),
pos as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from (select distinct doc_id, i, k from hit)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
          from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(pos.n_hit, 0) as bigint) as n_hit,
       cast(coalesce(items.n_items, 0) as bigint) as n_items, sha256(coalesce(items.ids, '')) as items_sha256,
       coalesce(pos.n_hit, 0) > 0 as contaminated
from dw d left join pos on pos.doc_id = d.doc_id left join items on items.doc_id = d.doc_id
"""
