"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts counts the character n-grams of one to
four characters that occur in both, divided by the geometric mean of their numbers of
distinct n-grams.  N-grams are hashed to a fixed number of slots; lower-cased letters
(Unicode's, with their marks) count, other characters are word limits.  Nystroem landmarks, some texts of every language,
give each text finite features K(x, Z) K(Z, Z)^(-1/2); on these, kernel ridge regression is
solved for one language against the rest.  Texts are scored by batches: a sparse 0/1 matrix
of present n-grams times the product of the landmarks' matrix and the projected weights.

The model is fitted on at most `max_train` distinct rows, for each language those of the
smallest hash of id and text, dealt evenly to languages, so that a rare language is learnt, too;
all rows are scored, from their whole text.

Decided cases: null texts and texts without a letter are `und` with score 0; null
languages are not learnt; with no language to learn every text is `und`; of equal scores
the language first in alphabetical order wins; repeated rows give repeated results and are
learnt once; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, map_rows, record, sent_if_small, table, written

MAX_TRAIN = 3_000
LANDMARKS = 96
SLOTS = 1 << 17
LONGEST = 4
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
#: Characters among which Python's words may have others than letters; without them its faster patterns tell the same.
_BEYOND = re.compile("[\xb2\xb3\xb9\xbc-\xbe\u0300-\U0010ffff]")
_OTHER_LATIN = re.compile(r"[\W\d_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def presence(text: str, slots: int = SLOTS) -> np.ndarray:
    """The distinct slots of a text's n-grams; none if it has no letter."""
    lower = text.lower()
    if _BEYOND.search(lower):
        bare = _OTHER.sub(" ", lower).strip()
        blank = not _LETTER.search(bare)
    else:
        bare = _OTHER_LATIN.sub(" ", lower).strip()
        blank = not bare
    if blank:
        return np.zeros(0, np.int32)
    codes = np.frombuffer(f" {bare} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    shift = np.uint64(65 - slots.bit_length())
    rolled = np.zeros(len(codes), np.uint64)
    found = []
    for n in range(min(LONGEST, len(codes))):
        rolled = rolled[: len(codes) - n] * np.uint64(1000003) + codes[n:]
        found.append((((rolled + np.uint64(n)) * _MIX[n]) >> shift).astype(np.int32))
    every = np.concatenate(found)
    if len(every) < slots // 128:
        return np.unique(every)
    there = np.zeros(slots, np.bool_)
    there[every] = True
    return np.flatnonzero(there).astype(np.int32)


#: Numbers gathered at once by `product`, but for one text's.
_GATHERED = 8_000_000


def product(slots_of: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """The texts' presence matrix, each row divided by the root of its number of ones, times `matrix` (slots x columns)."""
    out = np.zeros((len(slots_of), matrix.shape[1]), np.float64)
    size = np.array([len(x) for x in slots_of], np.int64)
    own = np.flatnonzero(size)
    part = np.cumsum(size[own]) * matrix.shape[1] // _GATHERED
    for rows in np.split(own, np.flatnonzero(np.diff(part)) + 1) if len(own) else ():
        begin = np.cumsum(size[rows]) - size[rows]
        sums = np.add.reduceat(matrix[np.concatenate([slots_of[k] for k in rows])], begin, axis=0, dtype=np.float64)
        out[rows] = sums / np.sqrt(size[rows])[:, None]
    return out


@dataclass
class KernelModel:
    langs: list[str]
    weights: np.ndarray  # slots x languages: landmarks, K(Z, Z)^(-1/2) and ridge weights multiplied
    bias: np.ndarray

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        slots_of = [presence(t) for t in texts]
        margins = product(slots_of, self.weights) + self.bias
        best = margins.argmax(1)
        odds = np.exp(4.0 * (margins - margins.max(1, keepdims=True)))
        score = 1 / odds.sum(1)
        blank = np.array([not len(x) for x in slots_of], np.bool_)
        score[blank] = 0.0
        return ["und" if b else self.langs[k] for k, b in zip(best, blank, strict=True)], score


def fit(slots_of: list[np.ndarray], langs: list[str], n_landmarks: int = LANDMARKS, ridge: float = 1e-3) -> KernelModel:
    """`slots_of`: what `presence` gives, in a fixed order; landmarks are the first texts of each language in turn."""
    names = sorted(set(langs))
    used = [k for k, x in enumerate(slots_of) if len(x)]
    if not used:
        return KernelModel([], np.zeros((SLOTS, 0), np.float32), np.zeros(0))
    rows, own = [slots_of[k] for k in used], np.array([langs[k] for k in used], dtype=object)
    seen: dict[str, int] = {}
    turn = []
    for lang in own:
        turn.append(seen.get(lang, 0))
        seen[lang] = turn[-1] + 1
    marks = [rows[k] for k in np.argsort(turn, kind="stable")[:n_landmarks]]
    z = np.zeros((SLOTS, len(marks)), np.float32)
    for k, there in enumerate(marks):
        z[there, k] = len(there) ** -0.5
    value, vector = np.linalg.eigh(product(marks, z))
    value = np.maximum(value, 1e-6 * value.max())
    root = vector * value**-0.5 @ vector.T
    features = product(rows, z) @ root
    target = np.where(own[:, None] == np.array(names, dtype=object), 1.0, -1.0)
    # every language weighs the same, however many rows it has
    weight = (1.0 / np.maximum(1, (target > 0).sum(0)))[np.array([names.index(o) for o in own])]
    weight /= weight.mean()
    full = np.hstack([features, np.ones((len(features), 1))])
    scaled = full * weight[:, None]
    penalty = ridge * len(full) * np.eye(full.shape[1])
    penalty[-1, -1] = 0.0
    solved = np.linalg.solve(full.T @ scaled + penalty, scaled.T @ target)
    return KernelModel(names, z @ (root @ solved[:-1]).astype(np.float32), solved[-1])


def train(docs: DataFrame, max_train: int = MAX_TRAIN, learn=None) -> KernelModel:
    """Fit on rows with text and lang where `learn` holds, at most `max_train` of them."""
    known = docs.where("doc_id is not null and text is not null and lang is not null")
    if learn is not None:
        known = known.where(learn)
    known = known.select("doc_id", "lang", "text").withColumn("mark", F.xxhash64("doc_id", "text"))
    keys = written(known.select("doc_id", "lang", "mark").distinct(), "langid-keys")
    counts = written(keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "langid-counts")
    # about twice as many of a language as could be taken, so that no task gets all its rows
    near = keys.join(sent_if_small(counts), "lang").where(_unit("mark") * F.col("n") < 2.0 * max_train)
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "doc_id"))
    sample = near.withColumn("turn", turn).where(F.col("turn") <= max_train).orderBy("turn", "lang").limit(max_train)
    # at most max_train rows of four narrow columns
    rows = known.join(F.broadcast(sample.select("doc_id", "lang", "mark", "turn")), ["doc_id", "lang", "mark"]).select("doc_id", "mark", "turn", "lang", "text")

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            slots = [presence(t).tobytes() for t in batch.column(4).to_pylist()]
            *keys, _ = batch.columns
            yield pa.RecordBatch.from_arrays([*keys, pa.array(slots, pa.binary())], names=["doc_id", "mark", "turn", "lang", "slots"])

        return step

    # slot numbers, not texts, go to the driver, once for repeated rows
    found = map_rows(rows, make, "doc_id long, mark long, turn int, lang string, slots binary")
    got = found.groupBy("doc_id", "mark", "turn", "lang").agg(F.first("slots").alias("slots")).collect()
    got.sort(key=lambda r: (r.turn, r.lang, r.doc_id, r.mark))
    return fit([np.frombuffer(r.slots, np.int32) for r in got], [r.lang for r in got])


def _unit(column: str):
    """A 64-bit hash as a number from 0 to 1."""
    return F.col(column) / float(1 << 64) + 0.5


def identify(docs: DataFrame, model: KernelModel) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            lang, score = model.decide([t or "" for t in batch.column(1).to_pylist()])
            yield record(doc_id=batch.column(0), lang_pred=pa.array(lang, pa.string()), score=pa.array(score, pa.float64()))

        return step

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double", 256)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, learn=~fold("doc_id", 5, 0))
    return identify(docs, model).select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")
