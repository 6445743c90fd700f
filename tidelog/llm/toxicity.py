"""Toxicity by compression distance.

zstandard dictionaries are trained on toxic and on ordinary text, apart from each other. Each window of a text, WINDOW
words every STRIDE words, is compressed twice: with the toxic dictionary and with its ordinary counterpart, both before
the same base dictionary, so that what any text repeats costs the same and the difference is due to what toxic text alone
repeats. A text's differences (largest, mean, mean of the largest three, how many and which share reach each of THRESHOLDS,
number of windows) go into a logistic calibration whose output is the score.

Training. Sampled texts are cut in windows, of which equal ones count once, so that copies of a document don't rule the
trainer. The base dictionary is trained on ordinary windows. A toxic text is mostly ordinary, so windows are chosen in
rounds: at first those that the base compresses worst; then, in each round, dictionaries are trained on the chosen windows
of one half of the texts and the windows of the other half that they favour most are chosen next, on the ordinary side by
the same measure. A window is never judged by a dictionary that has seen it. The round whose dictionaries rank the calibration
texts best (area under the curve) is taken. All dictionaries come from the library's trainer; where it refuses because
samples are too few, a dictionary is those samples themselves.

Samples are bounded: about `per_class` labelled rows of each class by hash, one in five for the calibration, and about
`windows` windows of each class for the trainer. Texts are used whole, and windows of all texts are scored.

Results: null and empty texts have no windows and get the calibrated score of that. Rows that repeat are kept; a doc_id with
several labels counts as toxic if one says so, one with several texts trains with each. If either class has no training
rows, every score is the share of label 1 among them (0 without any).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidelog.llm import common

WINDOW, STRIDE, LEVEL = 3, 2, 3
#: Follows each window, so that a short one isn't stored raw by both compressors, which would hide their difference.
PAD = b" " * 64
#: Bytes of the base dictionary and of the toxic one and its counterpart; the trainer's segment and substring lengths.
BASE_BYTES, OWN_BYTES = 32_768, 2_048
BASE_SEGMENT, OWN_SEGMENT, SUBSTRING = 32, 12, 6
#: Rounds of choosing windows, the share that the first one chooses and that the others do, and the least number.
ROUNDS, FIRST, KEPT, LEAST = 5, 0.5, 0.04, 300
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
THRESHOLDS = (3, 4, 5)
#: Label 1 weighs as if it were this share of the calibration's rows, whatever the sample holds.
PRIOR = 1 / 3
N_FEATURES = 4 + 2 * len(THRESHOLDS)


@dataclass
class Model:
    base: bytes
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray
    share: float


def windows(text: str | None, stride: int) -> list[bytes]:
    """A text's windows, `stride` words apart; the last one ends with the text's last word."""
    words = WORD.findall((text or "").lower().encode())
    if not words:
        return []
    run = b" " + b" ".join(words) + b" "
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.arange(0, max(1, len(words) - WINDOW + stride), stride)
    last = np.minimum(first + WINDOW, len(words)) - 1
    begins = np.append(0, ends[:-1])
    return [run[a : b + 1] for a, b in zip(begins[first].tolist(), ends[last].tolist(), strict=True)]


def _compressor(raw: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False).compress


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model
        self._ordinary, self._toxic = _compressor(model.ordinary + model.base), _compressor(model.toxic + model.base)

    def differences(self, found: list[bytes]) -> np.ndarray:
        """By how many bytes the toxic dictionary does better on each window."""
        o, t = self._ordinary, self._toxic
        return np.fromiter((len(o(x := w + PAD)) - len(t(x)) for w in found), np.int64, len(found))

    def features(self, text: str | None) -> np.ndarray:
        d = self.differences(windows(text, STRIDE))
        if not len(d):
            return np.zeros(N_FEATURES)
        reach = [(d >= t).sum() for t in THRESHOLDS]
        return np.array([d.max(), d.mean(), np.sort(d)[-3:].mean(), np.log1p(len(d)), *np.log1p(reach), *(np.array(reach) / len(d))])

    def score(self, text: str | None) -> float:
        w = self.model.weights
        if not len(w):
            return self.model.share
        z = float(w[0] + self.features(text) @ w[1:])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def labelled(docs: DataFrame, labels: DataFrame, train: Column, per_class: int) -> DataFrame:
    """toxic, fold and text of the sampled rows; fold 2 of 0, 1, 2 is for the calibration."""
    known = labels.where(F.col("toxic").isin(0, 1)).where(train).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = common.checkpointed(common.thinned(known, "toxic", per_class, F.col("doc_id")))
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")  # 2 x per_class rows
    texts = texts.dropDuplicates(["doc_id", "text"])
    luck = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(10))
    return texts.select("toxic", F.when(luck < 4, 0).when(luck < 8, 1).otherwise(2).alias("fold"), "text")


def dictionary(size: int, samples: list[bytes], segment: int) -> bytes:
    """A trained dictionary; the samples themselves if the trainer finds too little in them."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=SUBSTRING, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size].ljust(16, b" ")


def _spread(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def training_windows(sample: DataFrame, most: int) -> DataFrame:
    """toxic, fold, window: distinct windows of the texts that aren't for the calibration, about `most` of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for toxic, fold, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = windows(text, WINDOW)
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(found), pa.int32()), pa.array([fold] * len(found), pa.int32()), pa.array(found, pa.binary())], names=["toxic", "fold", "window"])

    each = sample.where("fold < 2").mapInArrow(run, "toxic int, fold int, window binary")
    once = common.checkpointed(each.groupBy("toxic", "window").agg(F.min("fold").alias("fold")))
    return common.written(_spread(common.thinned(once, "toxic", most, F.col("window"))), "toxic-windows")


def _chosen(found: DataFrame, share: float) -> dict[tuple[int, int], list[bytes]]:
    """Of each class and fold the `share` of windows with the largest d; ties by hash. found: toxic, fold, window, d."""
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for r in found.groupBy("toxic", "fold", "d").count().collect():  # d is a difference of some bytes
        counts.setdefault((r["toxic"], r["fold"]), {})[r["d"]] = r["count"]
    rules = F.lit(False)
    for (toxic, fold), by in counts.items():
        left, edge, part = max(LEAST, int(share * sum(by.values()))), -(1 << 30), 0.0
        for d in sorted(by, reverse=True):
            if by[d] >= left:
                edge, part = d, left / by[d]
                break
            left -= by[d]
        luck = F.xxhash64("window") / float(1 << 64) + 0.5
        rules = rules | ((F.col("toxic") == toxic) & (F.col("fold") == fold) & ((F.col("d") > edge) | ((F.col("d") == edge) & (luck <= part))))
    out: dict[tuple[int, int], list[bytes]] = {(y, f): [] for y in (0, 1) for f in (0, 1)}
    taken = found.where(rules).select("toxic", "fold", "window").toArrow()  # a share of the bounded sample of windows
    for toxic, fold, window in zip(*(c.to_pylist() for c in taken.columns), strict=True):
        out[toxic, fold].append(window)
    return {k: sorted(v) for k, v in out.items()}


def _judged(found: DataFrame, judges: dict[int, Model | None], base: bytes) -> DataFrame:
    """`found` with d of each window: by its fold's judge, or how badly the base compresses it where there is none."""
    shared = found.sparkSession.sparkContext.broadcast((judges, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, plain = shared.value
        scorers = {f: Scorer(m) for f, m in models.items() if m}
        alone = _compressor(plain)
        for b in batches:
            fold, window = b.column(1).to_numpy(), b.column(2).to_pylist()
            d = np.zeros(len(window), np.int64)
            for f in (0, 1):
                rows = np.flatnonzero(fold == f)
                own = [window[i] for i in rows]
                d[rows] = scorers[f].differences(own) if f in scorers else [100 * len(alone(w + PAD)) // len(w) for w in own]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d)], names=["toxic", "fold", "window", "d"])

    return common.written(found.select("toxic", "fold", "window").mapInArrow(run, "toxic int, fold int, window binary, d long"), "toxic-judged")


def area(score: np.ndarray, y: np.ndarray) -> float:
    """The area under the curve; equal scores count half."""
    _, place, times = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - (times - 1) / 2)[place]
    n = y.sum()
    return float((rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)))


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic weights, the intercept first, by Newton steps on standardised features."""
    share = y.mean()
    weight = np.where(y == 1, PRIOR / share, (1 - PRIOR) / (1 - share))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w, keep = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    keep[0, 0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + keep, z.T @ (weight * (y - p)) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[0] - (w[1:] * mean / scale).sum(), w[1:] / scale)


def _measured(texts: DataFrame, models: list[Model]) -> tuple[list[np.ndarray], np.ndarray]:
    """Features of the calibration texts under each model, and their labels."""
    shared = texts.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m) for m in shared.value]
        for b in batches:
            got = [np.concatenate([s.features(t) for s in scorers]).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = texts.select("toxic", "text").mapInArrow(run, "toxic int, x array<double>").collect()  # some numbers a sampled row
    rows.sort(key=lambda r: (r["toxic"], *r["x"]))
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(models), N_FEATURES)
    return [x[:, k] for k in range(len(models))], np.array([r["toxic"] for r in rows], float)


def trained(docs: DataFrame, labels: DataFrame, *, per_class: int = 3000, windows: int = 300_000, rounds: int = ROUNDS) -> Model:
    """A model from labelled rows whose crc32 remainder by 5 isn't 0."""
    common.small_batches(docs.sparkSession)
    sample = labelled(docs, labels, common.id_remainder(F.col("doc_id"), 5) != 0, per_class)
    sample = common.written(_spread(sample), "toxicity-sample")
    by = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    share = by.get(1, 0) / max(1, sum(by.values()))
    blank = b" " * 16
    if len(by) < 2:
        return Model(blank, blank, blank, np.zeros(0), float(share))
    found = training_windows(sample, windows)
    plain = sorted(found.where("toxic = 0").select("window").toArrow()["window"].to_pylist())  # about `windows` of some 20 bytes
    base = dictionary(BASE_BYTES, plain, BASE_SEGMENT)
    del plain

    def pair(toxic: list[bytes], ordinary: list[bytes]) -> Model:
        return Model(base, dictionary(OWN_BYTES, toxic, OWN_SEGMENT), dictionary(OWN_BYTES, ordinary, OWN_SEGMENT), np.zeros(0), float(share))

    judges: dict[int, Model | None] = {0: None, 1: None}
    models = []
    for k in range(rounds):
        chosen = _chosen(_judged(found, judges, base), KEPT if k else FIRST)
        models.append(pair(chosen[1, 0] + chosen[1, 1], chosen[0, 0] + chosen[0, 1]))
        judges = {f: pair(chosen[1, 1 - f], chosen[0, 1 - f]) for f in (0, 1)}
    features, y = _measured(sample.where("fold = 2"), models)
    if not len(y) or y.min() == y.max():
        return models[-1]
    best = None
    for model, x in zip(models, features, strict=True):
        model.weights = calibrated(x, y)
        got = area(x @ model.weights[1:], y)
        if best is None or got > best[0]:
            best = got, model
    return best[1]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with score, replacing a column of that name."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.drop("score")
    kept = docs.columns
    at = kept.index("text")
    shared = spark.sparkContext.broadcast(model)  # under 40 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            scores = [scorer.score(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*kept, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")
    held = (common.id_remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    return predict(docs, trained(docs, labels)).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
