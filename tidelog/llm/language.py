"""Language identification with a blended-spectrum string kernel.

The kernel of two texts is the number of character n-grams, 1 to N_MAX long, that both hold (presence, not counts),
over the geometric mean of how many each holds. N-grams are hashed to 2 ** DIM_BITS places. A bounded, stratified sample
of labelled rows gives landmarks; the Nystroem map turns kernel values against them into vectors whose dot products
approximate the kernel, and a ridge regression is fitted on these, one language against the rest. As the map and the
regression are linear in the kernel values, and these in a text's presence vector, scores of a batch are one matrix
product: presence (documents x places) by weights (places x languages).

Sample: about `per_language` labelled rows of each language by a hash, fewer where many languages would make that more
than `in_all` rows; nothing else is bounded. Texts are read whole, in training and in scoring. Repeated rows train once.

Results: a text that is null or has no letter is `und` with score 0. Ties go to the language that sorts first. Rows
that repeat are kept. Without labelled rows everything is `und`. Rows without a language never train.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidelog.llm import common

N_MAX, DIM_BITS = 3, 15
#: Code points that are hashed at once.
PIECE = 1 << 20


def has_letter(text: str | None) -> bool:
    """Whether a text has a character of Unicode's letter categories."""
    return bool(text) and any(map(str.isalpha, text))


def presence(text: str) -> np.ndarray:
    """The places of a text's n-grams, ascending, each once. Digits count as one character, white space as another."""
    out = np.zeros(1 << DIM_BITS, bool)
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    cps[(cps >= 48) & (cps <= 57)] = 48
    cps[(cps == 9) | (cps == 10) | (cps == 13)] = 32
    for at in range(0, len(cps), PIECE):
        part = cps[at : at + PIECE + N_MAX - 1]
        h = np.zeros(len(part), np.uint64)
        for n in range(1, N_MAX + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) + part[n - 1 :] + np.uint64(n)
            out[((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - DIM_BITS)).astype(np.int64)] = True
    return np.flatnonzero(out)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # places x languages, float32
    bias: np.ndarray
    sharp: float

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and its score of each text, by one product for each batch of rows."""
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        for at in range(0, len(rows), 128):
            part = rows[at : at + 128]
            found = [presence(texts[i]) for i in part]
            x = np.zeros((len(part), 1 << DIM_BITS), np.float32)
            for k, p in enumerate(found):
                x[k, p] = 1 / np.sqrt(len(p))
            y = (x @ self.weights + self.bias) * self.sharp
            y = np.exp(y - y.max(1, keepdims=True))
            y /= y.sum(1, keepdims=True)
            best = y.argmax(1)
            for k, i in enumerate(part):
                names[i], scores[i] = self.languages[best[k]], float(y[k, best[k]])
        return names, scores


def _unpacked(packed: list[bytes]) -> np.ndarray:
    """Presence vectors of length one."""
    x = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(rows: list[tuple[str, bytes]], landmarks: int = 256, ridge: float = 1e-2) -> Model:
    """rows: language and presence as packed bits; they are unpacked a block at a time."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return Model([], np.zeros((1 << DIM_BITS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    y = np.array([[1.0 if lang == m else -1.0 for m in languages] for lang, _ in rows])
    # Landmarks: every so many rows of those ordered by language, so that each language has its share.
    order = np.argsort([lang for lang, _ in rows], kind="stable")
    at = order[np.linspace(0, len(rows) - 1, min(landmarks, len(rows))).astype(int)]
    marks = _unpacked([rows[i][1] for i in at])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # kernel values against landmarks -> Nystroem vectors
    blocks = (rows[k : k + 128] for k in range(0, len(rows), 128))
    z = np.vstack([(_unpacked([p for _, p in part]) @ marks.T).astype(np.float64) for part in blocks]) @ root
    mean, target = z.mean(0), y.mean(0)
    zc = z - mean
    w = np.linalg.solve(zc.T @ zc + ridge * len(rows) * np.eye(z.shape[1]) / z.shape[1], zc.T @ (y - target))
    return Model(languages, (marks.T @ (root @ w)).astype(np.float32), (target - mean @ w).astype(np.float32), 4.0)


def sample(docs: DataFrame, train: Column, per_language: int, in_all: int) -> list[tuple[str, bytes]]:
    """About `per_language` labelled rows of each language, as packed presence: 4 KiB a row whatever the text's length.

    Where there are so many languages that this would be more than `in_all` rows, each language gives fewer, 4 at least.
    """
    labelled = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", "doc_id")
    n = labelled.select("lang").distinct().count()
    chosen = common.thinned(labelled, "lang", max(4, min(per_language, in_all // max(1, n))), F.xxhash64("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = []
            for t in b.column(1).to_pylist():
                bits = np.zeros(1 << DIM_BITS, bool)
                bits[presence(t)] = True
                packed.append(np.packbits(bits).tobytes() if has_letter(t) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["lang", "bits"])

    rows = chosen.select("lang", "text").mapInArrow(run, "lang string, bits binary").where("bits is not null").collect()
    return sorted((r["lang"], bytes(r["bits"])) for r in rows)


def trained(docs: DataFrame, *, per_language: int = 300, in_all: int = 6000) -> Model:
    common.small_batches(docs.sparkSession)
    return fit(sample(docs, common.id_remainder(F.col("doc_id"), 4) != 2, per_language, in_all))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred and score, replacing columns of those names."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.drop("lang_pred", "score")
    kept = docs.columns
    at = kept.index("text")
    shared = spark.sparkContext.broadcast(model)  # places x languages floats: 128 KiB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = shared.value.score(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*kept, "lang_pred", "score"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def identified(docs: DataFrame, *, least: float = 0.0) -> DataFrame:
    """The documents with a language, as far as the model is at least `least` sure of it."""
    away = {c: f"__kept_{c}" for c in ("lang_pred", "score") if c in docs.columns}  # the documents' own columns of these names
    found = predict(docs.withColumnsRenamed(away), trained(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in away.items()}).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = trained(docs)
    held = (common.id_remainder(F.col("doc_id"), 4) == 2).alias("held_out")
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")
