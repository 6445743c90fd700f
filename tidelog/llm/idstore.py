"""Token ids as binary shards with a minimal perfect hash index over document keys.

A store is a folder of pairs of files, one pair for each range of ascending keys, and a directory:

* `NNNNNN.ids`: the ids of the shard's documents, one after the other, little-endian, unsigned, 2 bytes wide where the
  vocabulary fits and 4 otherwise; nothing else;
* `NNNNNN.idx`: magic, length of a JSON header, header, then three arrays. `blocks` are the bit sets of a cascade: a key is
  placed in the first level where no other key shares its bit. A block has the number of bits set before it and 512 bits,
  so the rank of a bit, which is the key's slot, takes one block. `slots` have a 32-bit fingerprint of the key, the place of
  its first document in the shard and how many documents bear the key. `ends` has where each document's ids end;
* `directory` (Parquet): a row a shard with its first and last key, its documents, its ids, and all ids before it.

A lookup finds the shards that can hold a key by halving the directory, and in each reads a few blocks, one slot, two ends and
the ids, each at its place: constant time, and nothing of the index is read whole. A key that very many documents bear may
go on in the next shards; then the directory names these too.

Beside the files, `keys` (Parquet) lists which key is in which shard. Shards are written under a name of the task
attempt and then renamed, so that a lost executor leaves no half shard.

Results: null text counts as empty and gets the end id alone. Rows with the same key stay adjacent, ordered by a hash of
their text, and each is kept. A null key sorts first. An empty table gives an empty store.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm import common, pieces

MAGIC = b"TDLGIDX1"
GAMMA = 1.7
#: Distinct pieces whose ids a worker keeps.
MAX_PIECES = 300_000
#: Bytes of text that a shard holds about, and of ids that are read at once.
SHARD_BYTES, READ_BYTES = 256 << 20, 8 << 20
#: Stands for a null key, and so sorts first.
NULL_KEY = -(2**63)
KEYS = "key long, shard int, copy long, n long"
DIRECTORY = "shard int, first long, last long, docs long, ids long, before long"


# The index


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A one-to-one scrambling of 64-bit keys (the finaliser of splitmix64)."""
    x = keys + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


BLOCK = np.dtype([("rank", "<u8"), ("bits", "u1", 64)])
SLOT = np.dtype([("print", "<u4"), ("first", "<u4"), ("run", "<u4")])
BLOCK_BITS = 512


def build_levels(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The sizes of the levels that place distinct keys, and their blocks one level after the other."""
    sizes, parts, before = [], [], 0
    while len(keys):
        size = -(-max(64, int(GAMMA * len(keys)) + 1) // BLOCK_BITS) * BLOCK_BITS
        at = (mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
        bits = np.bincount(at, minlength=size) == 1
        blocks = np.zeros(size // BLOCK_BITS, BLOCK)
        blocks["bits"] = np.packbits(bits, bitorder="little").reshape(-1, 64)
        per = bits.reshape(-1, BLOCK_BITS).sum(1)
        blocks["rank"] = before + np.cumsum(per) - per
        before += int(per.sum())
        sizes.append(size)
        parts.append(blocks)
        keys = keys[~bits[at]]
    return sizes, np.concatenate(parts) if parts else np.zeros(0, BLOCK)


def ranked(blocks: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The rank of each bit (0 to 511) in its block among all bits set, -1 where the bit isn't set."""
    at, shift = bit >> 3, (bit & 7).astype(np.uint8)
    rows = np.arange(len(blocks))
    own = blocks["bits"][rows, at]
    full = np.where(np.arange(64) < at[:, None], blocks["bits"], 0)
    below = np.bitwise_count(full).sum(1, dtype=np.int64) + np.bitwise_count(own & ((np.uint8(1) << shift) - np.uint8(1)))
    return np.where(own >> shift & 1 == 1, blocks["rank"].astype(np.int64) + below, -1)


class Index:
    """A shard's index: keys to documents."""

    def __init__(self, sizes: list[int], blocks: np.ndarray, slots: np.ndarray, ends: np.ndarray) -> None:
        self.sizes, self.blocks, self.slots, self.ends = sizes, blocks, slots, ends

    @classmethod
    def build(cls, keys: np.ndarray, lengths: np.ndarray) -> Index:
        """keys: of the documents in order, equal ones adjacent; lengths: their ids."""
        fresh = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        distinct = keys[fresh].view(np.uint64)
        out = cls(*build_levels(distinct), np.zeros(len(distinct), SLOT), np.cumsum(lengths).astype(np.uint64))
        slot = out.slot_of(distinct)
        out.slots["print"][slot], out.slots["first"][slot], out.slots["run"][slot] = fingerprints(distinct), fresh, np.diff(np.append(fresh, len(keys)))
        return out

    def slot_of(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for a key that isn't in the set any slot or -1."""
        got, left, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64)
            got[left] = ranked(self.blocks[before + at // BLOCK_BITS], at % BLOCK_BITS)
            left, before = left[got[left] < 0], before + size // BLOCK_BITS
        return got

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key's first document, -1 where the fingerprint disagrees."""
        k = keys.view(np.uint64)
        slot = self.slot_of(k)
        ok = slot >= 0
        ok[ok] = self.slots["print"][slot[ok]] == fingerprints(k[ok])
        out = np.full(len(keys), -1, np.int64)
        out[ok] = self.slots["first"][slot[ok]]
        return out

    def to_bytes(self) -> bytes:
        head = json.dumps({"levels": self.sizes, "keys": len(self.slots), "docs": len(self.ends)}).encode()
        return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, self.blocks.tobytes(), self.slots.tobytes(), self.ends.astype("<u8").tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> Index:
        if raw[:8] != MAGIC:
            raise ValueError("not an index file")
        at = 12 + int.from_bytes(raw[8:12], "little")
        head = json.loads(raw[12:at])
        arrays = []
        for n, t in ((sum(head["levels"]) // BLOCK_BITS, BLOCK), (head["keys"], SLOT), (head["docs"], np.dtype("<u8"))):
            arrays.append(np.frombuffer(raw, t, n, at))
            at += n * t.itemsize
        return cls(head["levels"], *arrays)


class OnDisk:
    """An index file of which only what a key needs is read."""

    def __init__(self, file) -> None:
        self._file = file
        start = file.read_at(12, 0)
        if start[:8] != MAGIC:
            raise ValueError("not an index file")
        size = int.from_bytes(start[8:12], "little")
        head = json.loads(file.read_at(size, 12))
        self._levels, self._blocks = head["levels"], 12 + size
        self._slots = self._blocks + sum(self._levels) // BLOCK_BITS * BLOCK.itemsize
        self._ends = self._slots + head["keys"] * SLOT.itemsize

    def _row(self, at: int, kind: np.dtype, n: int = 1) -> np.ndarray:
        return np.frombuffer(self._file.read_at(n * kind.itemsize, at), kind)

    def ends(self, key: int) -> np.ndarray:
        """Where the ids of the key's documents begin and end, in ids: one number more than documents; empty without the key."""
        k, before = np.array([key], np.int64).view(np.uint64), 0
        for level, size in enumerate(self._levels):
            at = int(mixed(k, level)[0] % np.uint64(size))
            block = self._row(self._blocks + (before + at // BLOCK_BITS) * BLOCK.itemsize, BLOCK)
            if (rank := int(ranked(block, np.array([at % BLOCK_BITS]))[0])) >= 0:
                slot = self._row(self._slots + rank * SLOT.itemsize, SLOT)[0]
                if slot["print"] != fingerprints(k)[0]:
                    break
                first, run = int(slot["first"]), int(slot["run"])
                got = self._row(self._ends + 8 * max(0, first - 1), np.dtype("<u8"), run + (first > 0)).astype(np.int64)
                return got if first else np.append(0, got)
            before += size // BLOCK_BITS
        return np.zeros(0, np.int64)


# Encoding


class Encoder:
    """Ids by the tokenizers library; pieces that come up again are encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.type = np.dtype(f"<u{self.width}")
        self.classes = pieces.Classes(self.library)
        self.spaced = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.spaced[i] = token[0] == "Ġ"  # stands for the space
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _learn(self, fresh: list[bytes]) -> list[bytes]:
        """Ids of pieces. Words that begin with a space are put together, as the library cuts them apart there again."""
        out: list[bytes] = [b""] * len(fresh)
        words, rest = [], []
        for i, x in enumerate(fresh):
            text = x.decode()
            joins = len(text) > 1 and text[0] == " " and text[1] < "ɐ" and text[1].isalpha()
            (words if joins else rest).append((i, text))
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(self.library.encode_batch_fast(["".join(t for _, t in part)], add_special_tokens=False)[0].ids, np.int64)
            begins = np.append(np.flatnonzero(self.spaced[ids]), len(ids))
            if len(begins) != len(part) + 1:
                rest += part
                continue
            raw = ids.astype(self.type).tobytes()
            for (i, _), a, b in zip(part, (begins[:-1] * self.width).tolist(), (begins[1:] * self.width).tolist(), strict=True):
                out[i] = raw[a:b]
        if rest:
            for (i, _), e in zip(rest, self.library.encode_batch_fast([t for _, t in rest], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, self.type).tobytes()
        return out

    def _ids(self, distinct: list[bytes]) -> list[bytes]:
        if len(self.known) > MAX_PIECES:
            self.old, self.known = self.known, {}  # pieces still in use come back from `old`
        known, old = self.known, self.old
        got = list(map(known.get, distinct))
        for i, x in enumerate(got):
            if x is None and (x := old.get(distinct[i])) is not None:
                got[i] = known[distinct[i]] = x
        missing = [i for i, x in enumerate(got) if x is None]
        if missing:
            for i, ids in zip(missing, self._learn([distinct[i] for i in missing]), strict=True):
                got[i] = ids
                if len(distinct[i]) <= 64:
                    known[distinct[i]] = ids
        return got

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and where each text's ids begin (one more at the end)."""
        batch = pieces.Batch(column)
        n = len(batch.cps)
        if not n:
            return np.zeros(0, self.type), np.zeros(len(column) + 1, np.int64)
        found = {content: batch.special(content) for content in self.special}
        breaks = np.zeros(n + 1, bool)
        breaks[batch.starts[:-1]] = True
        for content, at in found.items():
            breaks[at] = breaks[at + len(content)] = True
        mark = np.zeros(n + 1, bool)
        mark[pieces.vector_cuts(batch.cps, self.classes.of(batch.cps), np.flatnonzero(breaks[:-1]))] = True
        for content, at in found.items():
            for a in at:
                mark[a + 1 : a + len(content)] = False
        cuts = np.flatnonzero(mark[:-1])
        encoded = batch.pieces(cuts).dictionary_encode()
        codes = encoded.indices.to_numpy()
        values = self._ids(encoded.dictionary.to_pylist())
        size = np.fromiter(map(len, values), np.int64, len(values)) // self.width
        flat = np.frombuffer(b"".join(values), self.type)
        begin = np.cumsum(size) - size
        each = size[codes]
        ends = np.cumsum(each)
        take = np.arange(ends[-1]) + np.repeat(begin[codes] - (ends - each), each)
        at = np.searchsorted(cuts, batch.starts)
        return flat[take], np.append(0, ends)[at]


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    import public_tokenizers

    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(public_tokenizers.path(tokenizer))
    return _encoders[tokenizer]


# Stores


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, *, key: str = "doc_id", text: str = "text", n_shards: int | None = None) -> None:
    """Write `docs` as a store at `path`, a URI that the executors share. Shards are as many as texts of SHARD_BYTES need."""
    spark = docs.sparkSession
    common.small_batches(spark)
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    if n_shards is None:
        size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    slim = slim.repartitionByRange(n_shards, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        work = encoder(tokenizer)
        fs, root = _store(path)
        fs.create_dir(root, recursive=True)
        own = f"{root}/{shard:06d}.attempt{task.taskAttemptId()}"
        keys, lengths, last, run_at = [], [], None, 0
        with fs.open_output_stream(f"{own}.ids") as out:
            while first is not None:
                ids, at = work.encode(first.column(1))
                at = at + np.arange(len(at))  # an end id follows each document
                whole = np.full(at[-1], end_id, work.type)
                inside = np.ones(len(whole), bool)
                inside[at[1:] - 1] = False
                whole[inside] = ids
                out.write(whole.tobytes())
                own_keys = first.column(0).fill_null(NULL_KEY).to_numpy()
                keys.append(own_keys)
                lengths.append(np.diff(at))
                # Which of the documents with the same key it is; they are adjacent, if need be across batches.
                fresh = np.append(last is None or own_keys[0] != last, own_keys[1:] != own_keys[:-1])
                place = np.arange(len(own_keys))
                since = np.maximum.accumulate(np.where(fresh, place, 0))
                copy = place - since + np.where(np.cumsum(fresh) == 0, run_at, 0)
                last, run_at = own_keys[-1], int(copy[-1]) + 1
                yield pa.RecordBatch.from_arrays([first.column(0), pa.array(np.full(first.num_rows, shard, np.int32)), pa.array(copy), pa.array(lengths[-1])], names=["key", "shard", "copy", "n"])
                first = next((b for b in batches if b.num_rows), None)
        with fs.open_output_stream(f"{own}.idx") as out:
            out.write(Index.build(np.concatenate(keys), np.concatenate(lengths)).to_bytes())
        for kind in ("ids", "idx"):
            fs.move(f"{own}.{kind}", f"{root}/{shard:06d}.{kind}")

    slim.mapInArrow(run, KEYS).write.parquet(f"{path}/keys")
    keys = spark.read.schema(KEYS).parquet(f"{path}/keys").withColumn("key", F.coalesce("key", F.lit(NULL_KEY)))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    each = keys.groupBy("shard").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("docs"), F.sum("n").alias("ids"))
    each = each.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0))).orderBy("shard")
    each.coalesce(1).write.parquet(f"{path}/directory")


def read_store(spark: SparkSession, path: str, width: int) -> DataFrame:
    """key, shard, start, n_tokens and ids_crc32 of each document, by keyed access to the files of the store."""
    keys = spark.read.schema(KEYS).parquet(f"{path}/keys")
    starts = spark.read.schema(DIRECTORY).parquet(f"{path}/directory").select("shard", F.col("before").alias("base"))
    # Rows stay where their shard's file of keys put them: each task reads the shards that it meets.
    asked = keys.join(F.broadcast(starts), "shard").select("key", "shard", "base", "copy")  # a row a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(path)
        at, index, ids = -1, None, None
        for b in batches:
            shards, bases, copies = (b.column(k).to_numpy() for k in (1, 2, 3))
            keys = b.column(0).fill_null(NULL_KEY).to_numpy()
            start, n, crc = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for shard in np.unique(shards):
                if shard != at:
                    with fs.open_input_stream(f"{root}/{shard:06d}.idx") as f:
                        index = Index.from_bytes(f.read())
                    ids, at = fs.open_input_file(f"{root}/{shard:06d}.ids"), shard
                rows = np.flatnonzero(shards == shard)
                place = index.find(keys[rows])
                if (place < 0).any():
                    raise KeyError(f"shard {shard} lacks a key of its list")
                place = place + copies[rows]
                ends = index.ends[place].astype(np.int64)
                begins = np.where(place > 0, index.ends[np.maximum(place - 1, 0)], 0).astype(np.int64)
                start[rows], n[rows] = bases[rows] + begins, ends - begins
                # Neighbours are read together, READ_BYTES at most at once but for a longer document.
                order, k = np.argsort(begins, kind="stable"), 0
                while k < len(order):
                    low = int(begins[order[k]])
                    j = k + 1
                    while j < len(order) and (int(ends[order[j]]) - low) * width <= READ_BYTES:
                        j += 1
                    high = int(ends[order[k:j]].max())
                    raw = np.frombuffer(ids.read_at((high - low) * width, low * width), f"<u{width}").astype("<u4")
                    for i in order[k:j].tolist():
                        crc[rows[i]] = zlib.crc32(raw[begins[i] - low : ends[i] - low].tobytes())
                    k = j
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(start), pa.array(n), pa.array(crc)], names=["key", "shard", "start", "n_tokens", "ids_crc32"])

    return asked.mapInArrow(run, "key long, shard int, start long, n_tokens long, ids_crc32 long")


class Reader:
    """Keyed access to a store from one process. The directory, a row a shard, is kept; nothing else is."""

    def __init__(self, path: str, width: int) -> None:
        import pyarrow.parquet as pq

        self._fs, self._root = _store(path)
        self.width = width
        self.directory = pq.read_table(f"{self._root}/directory", filesystem=self._fs).sort_by("shard").to_pydict()

    def shards(self, key: int) -> range:
        """Places in the directory of the shards whose keys reach from or below the key to or above it."""
        from bisect import bisect_left, bisect_right

        return range(bisect_left(self.directory["last"], key), bisect_right(self.directory["first"], key))

    def get(self, key: int | None) -> list[tuple[int, np.ndarray]]:
        """Each document with the key: how many ids of the store are before it, and its ids."""
        key, out = NULL_KEY if key is None else key, []
        for place in self.shards(key):
            name = f"{self._root}/{self.directory['shard'][place]:06d}"
            with self._fs.open_input_file(f"{name}.idx") as f:
                ends = OnDisk(f).ends(key)
            if len(ends) > 1:
                with self._fs.open_input_file(f"{name}.ids") as f:
                    raw = np.frombuffer(f.read_at(int(ends[-1] - ends[0]) * self.width, int(ends[0]) * self.width), f"<u{self.width}")
                cut = (ends - ends[0]).tolist()
                out += [(self.directory["before"][place] + int(ends[0]) + a, raw[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        return out


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    path = common.scratch_path(spark, "idstore")
    write_store(docs, path, "byte_bpe_50k.json", 2)
    return read_store(spark, path, 2).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")
