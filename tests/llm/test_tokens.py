import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm import common, idstore, pieces, tokens

from . import plain

NAME = "byte_bpe_50k.json"
PATH = public_tokenizers.path(NAME)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_counts(spark, library):
    rows = plain.documents()
    df = plain.frame(spark, rows, n_tokens="clash", __text="x")
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(df.drop("__text"), NAME).collect())
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert got == sorted((i is not None, i, len((t or "").encode()), k, k > 512) for (i, t), k in zip(rows, n, strict=True))
    assert tokens.count_tokens(df.drop("__text").limit(0), NAME).count() == 0


ODD = st.text(st.sampled_from("'stmdrvleSTL aB1!\n\t 　é日½<|>"), max_size=40) | st.text(max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD, min_size=1, max_size=5))
def test_any_text(texts):
    library, column = idstore.encoder(NAME).library, pa.array(texts)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokens.counter(PATH).counts(column).tolist() == [len(w) for w in want]
    ids, at = idstore.encoder(NAME).encode(column)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


def test_prefix_scan_agrees_with_one_walk():
    rng = np.random.default_rng(0)
    symbols = np.append(rng.integers(0, tokens.N_CLASSES, 5000).astype(np.uint8), tokens.END)
    state, marks = tokens.START, []
    for c in symbols:
        marks.append(tokens.OUT[state * tokens.N_CLASSES + c])
        state = tokens.STEP[state * tokens.N_CLASSES + c]
    want = [i for i in range(len(symbols)) if marks[i] & 1 or (i + 1 < len(symbols) and marks[i + 1] & 2)]
    assert tokens.split(symbols).tolist() == want


def test_merger_forgets(monkeypatch, library):
    monkeypatch.setattr(tokens, "MAX_STATES", 50)
    monkeypatch.setattr(tokens, "MAX_PIECES", 20)
    own = tokens.Counter(PATH)
    texts = [t for _, t in plain.documents() if t]
    for t in texts:
        assert own.counts(pa.array([t]))[0] == len(library.encode(t, add_special_tokens=False).ids)


def test_classes_are_complete(library):
    c = pieces.Classes(library).of(np.array([32, 10, 0x61, 0x39, 0x21, 0x00A0, 0xE9, 0xBD, 0x3000], np.uint32))
    assert c.tolist() == [pieces.SP, pieces.WS, pieces.L, pieces.N, pieces.P, pieces.WS, pieces.L, pieces.N, pieces.WS]


def test_store_round_trip(spark, library):
    rows = plain.documents()
    path = common.scratch_path(spark, "test-store")
    idstore.write_store(plain.frame(spark, rows), path, NAME, 2, n_shards=4)
    got = idstore.read_store(spark, path, 2).collect()
    want = {}
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    for r in got:
        have.setdefault(r["key"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    order = sorted(got, key=lambda r: (r["key"] is not None, r["key"] or 0, r["start"]))
    total = 0
    for r in order:
        assert r["start"] == total
        total += r["n_tokens"]
    reader = idstore.Reader(path, 2)
    for key in sorted({r["key"] for r in got if r["key"] is not None}) + [None]:
        mine = sorted((r["start"], r["n_tokens"], r["ids_crc32"]) for r in got if r["key"] == key)
        assert [(a, len(x), zlib.crc32(x.astype("<u4").tobytes())) for a, x in reader.get(key)] == mine
    assert all(reader.get(k) == [] for k in (987654321, -6, 12))


def test_hot_key_over_shards(spark, library):
    """A key that half of all rows bear goes on in several shards; all of its documents are found by the key alone."""
    rows = [(5, f"copy {i}") for i in range(400)] + [(i, f"other {i}") for i in range(6, 400)]
    path = common.scratch_path(spark, "test-hot")
    df = plain.frame(spark, rows)
    idstore.write_store(df, path, NAME, 2, n_shards=8)
    reader = idstore.Reader(path, 2)
    assert len(reader.shards(5)) > 1
    found = [library.decode(x.tolist()[:-1]) for _, x in reader.get(5)]
    assert sorted(found) == sorted(t for i, t in rows if i == 5)
    assert [library.decode(x.tolist()[:-1]) for _, x in reader.get(77)] == ["other 77"]


def test_shards_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(idstore, "SHARD_BYTES", 2000)
    path = common.scratch_path(spark, "test-sizes")
    idstore.write_store(plain.frame(spark, [(i, "word " * 20) for i in range(400)]), path, NAME, 2)
    assert len(idstore.Reader(path, 2).directory["shard"]) > 10


def test_store_query(spark, sf_dir, library):
    """The query over a whole table, held against the library."""
    got = {r["doc_id"]: tuple(r)[1:] for r in idstore.query(spark, sf_dir).collect()}
    total, docs = 0, sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(docs)
    for r in docs:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert got[r["doc_id"]] == (total, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        total += len(ids)


def test_empty_store(spark):
    path = common.scratch_path(spark, "test-empty")
    idstore.write_store(plain.frame(spark, plain.documents()).limit(0), path, NAME, 2)
    assert idstore.read_store(spark, path, 2).count() == 0


def test_index_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 20_000))
    index = idstore.Index.from_bytes(idstore.Index.build(keys, np.ones(len(keys), np.int64)).to_bytes())
    assert index.find(keys).tolist() == list(range(len(keys)))
    assert sum(index.sizes) < 5 * len(keys) and len(index.slots) == len(keys)
    assert (index.find(np.arange(10_000)) >= 0).sum() <= 2  # strangers rarely pass the fingerprint
