"""Quality classifier by Bradley-Terry pairwise ranking.

A text's strength is linear in features of its whole text: shares of kinds of characters,
repetition, lengths, and shares of hashed words and byte trigrams.  The chance that a text of
label 1 beats one of label 0 is the logistic function of the difference of their
strengths, so the weights are a logistic regression on feature differences of preference
pairs.  The threshold comes from quantiles of the training strengths: if nearly all texts of
label 0 (99 %) are below nearly all of label 1, the middle of that gap, else the quantile
at the share of label 0.  A score is the logistic function of the strength above it, so 0.5
is the threshold.

The model is fitted on at most `max_labels` labelled rows, those of the smallest hash of
their id, one for each id and label, and at most `max_pairs` pairs.  All rows are scored.

Decided cases: null and empty texts have the features of no words and are scored; labels
other than 0 and 1 and null labels or ids are left out; ties in strength get equal scores;
repeated rows give repeated results and count once in training, as do several texts of one id
(the one of the smallest hash); with no pair to learn from every score is 0.5; extra
columns are left out by `quality_scores`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, map_rows, record, table, written

MAX_LABELS = 10_000
MAX_PAIRS = 50_000
#: Slots of hashed words, and of hashed byte trigrams.
WORD_SLOTS, GRAM_SLOTS = 128, 256

_CLASSES = [
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"?", b".", b",;:",
    b"#$%&*", b"|", b"<>{}[]()", b"/\\@=_+~^`", b"'\"-", bytes(range(128, 256)),
]
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES):
    _CLASS_OF[list(_bytes), _k] = 1
#: Words of a stretch in which distinct words are counted, so that long texts compare with short ones.
_STRETCH = 50


def _hashed(data: bytes, words: list[str]) -> np.ndarray:
    """Roots of the shares of hashed words and byte trigrams; white space is one kind of byte."""
    digests = np.fromiter((crc32(w.encode()) for w in words), np.int64, len(words)) % WORD_SLOTS
    of_words = np.bincount(digests, minlength=WORD_SLOTS) / max(1, len(words))
    codes = np.frombuffer(b" ".join(data.split()), np.uint8).astype(np.uint32)
    grams = (((codes[:-2] << 16) + (codes[1:-1] << 8) + codes[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    of_grams = np.bincount(grams, minlength=GRAM_SLOTS) / max(1, len(grams))
    return np.sqrt(np.concatenate([of_words, of_grams]))


def features(text: str) -> np.ndarray:
    """Shares of character classes, word and line repetition, lengths, hashed words and trigrams; of the whole text."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS_OF
    words = text.split()
    n, letters = len(words), sum(map(len, words))
    ink = counts.sum()  # white space, however much, says nothing
    shares = np.sqrt(counts / max(1, ink))
    fresh = sum(len(set(words[i : i + _STRETCH])) for i in range(0, n, _STRETCH))
    pairs = set(zip(words, words[1:], strict=False))
    lines = text.split("\n")
    plain = np.array([
        *shares,
        np.log1p(n),
        fresh / max(1, n),
        len(pairs) / max(1, n - 1),
        sum(map(eq, words, words[1:])) / max(1, n),
        sum(map(len, set(lines))) / max(1, sum(map(len, lines))),
        np.log1p(n / len(lines)),
        letters / max(1, n),
        ink / max(1, letters),
    ])
    return np.concatenate([plain, _hashed(data, words)])


@dataclass
class PairwiseModel:
    """Strength of features x: weights on the standardised, clipped x and on the squares of its first `squared` columns."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    squared: int

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([z, z[:, : self.squared] ** 2], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        strength = np.clip(self.expand(x) @ self.weights - self.threshold, -500, 500)
        return 1 / (1 + np.exp(-strength))


def fit(x: np.ndarray, label: np.ndarray, max_pairs: int = MAX_PAIRS, ridge: float = 1.0, seed: int = 7) -> PairwiseModel:
    """Newton steps on the logistic loss of feature differences of pairs (label 1, label 0)."""
    width = x.shape[1] if x.size else len(features(""))
    squared = width if width <= WORD_SLOTS + GRAM_SLOTS else width - WORD_SLOTS - GRAM_SLOTS
    good, poor = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(poor):
        return PairwiseModel(np.zeros(width), np.ones(width), np.zeros(width + squared), 0.0, squared)
    spread = x.std(0)
    model = PairwiseModel(x.mean(0).astype(np.float32), np.where(spread > 1e-9, spread, 1.0).astype(np.float32), np.zeros(width + squared), 0.0, squared)
    z = model.expand(x)
    random = np.random.default_rng(seed)
    n = min(max_pairs, len(good) * len(poor))
    if n == len(good) * len(poor):
        first, second = np.repeat(good, len(poor)), np.tile(poor, len(good))
    else:
        first, second = random.choice(good, n), np.resize(random.permutation(poor), n)
    w = model.weights
    for _ in range(12):
        gradient, curvature = -ridge * w, ridge * np.eye(len(w))
        for at in range(0, n, 8192):
            difference = z[first[at : at + 8192]] - z[second[at : at + 8192]]
            p = 1 / (1 + np.exp(-np.clip(difference @ w, -30, 30)))
            gradient = gradient + difference.T @ (1 - p)
            curvature += (difference * (p * (1 - p))[:, None]).T @ difference
        step = np.linalg.solve(curvature, gradient)
        w = w + step
        if np.abs(step).max() < 1e-5:
            break
    model.weights = w
    strength = z @ w
    low, high = np.quantile(strength[poor], 0.99), np.quantile(strength[good], 0.01)
    model.threshold = float((low + high) / 2 if low < high else np.quantile(strength, len(poor) / (len(good) + len(poor))))
    return model


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, learn=None) -> PairwiseModel:
    """Fit on labelled rows where `learn` (a Column on doc_id) holds; all by default."""
    own = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", "quality")
    if learn is not None:
        own = own.where(learn)
    own = written(own.distinct().withColumn("mark", F.xxhash64("doc_id", "quality")), "quality-labels")
    total = max(1, own.count())
    # about twice as many as are taken are looked at, so that no task sorts them all; few of them are no sample
    near = own.where((F.col("mark") / float(1 << 64) + 0.5) * total < 2.0 * max_labels) if total > 4 * max_labels else own
    # at most max_labels rows of 12 bytes: small enough for every executor
    sample = near.orderBy("mark", "doc_id", "quality").limit(max_labels).select("doc_id", "quality")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("mark"), "text")

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x = [features(t or "").astype(np.float32).tobytes() for t in batch.column(3).to_pylist()]
            *keys, _ = batch.columns
            yield pa.RecordBatch.from_arrays([*keys, pa.array(x, pa.binary())], names=["doc_id", "quality", "mark", "x"])

        return step

    found = map_rows(rows, make, "doc_id long, quality int, mark long, x binary")
    got = found.groupBy("doc_id", "quality").agg(F.min_by("x", "mark").alias("x")).collect()
    got.sort(key=lambda r: (r.doc_id, r.quality))  # the same model whatever order the tasks end in
    x = np.frombuffer(b"".join(r.x for r in got), np.float32).reshape(len(got), len(features("")))
    return fit(x, np.array([r.quality for r in got], np.int64))


def quality_scores(docs: DataFrame, model: PairwiseModel) -> DataFrame:
    """(doc_id, score, predicted) of every row."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x = np.array([features(t or "") for t in batch.column(1).to_pylist()])
            score = model.scores(x)
            yield record(
                doc_id=batch.column(0),
                score=pa.array(score, pa.float64()),
                predicted=pa.array((score >= 0.5).astype(np.int32), pa.int32()),
            )

        return step

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, model: PairwiseModel) -> DataFrame:
    """The rows of `docs`, all columns, whose text the model doesn't reject."""
    names = docs.columns

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x = np.array([features(t or "") for t in batch.column(names.index("text")).to_pylist()])
            yield batch.filter(pa.array(model.scores(x) >= 0.5))

        return step

    return map_rows(docs, make, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), learn=~fold("doc_id", 3, 1))
    return quality_scores(docs, model).select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", "predicted")
