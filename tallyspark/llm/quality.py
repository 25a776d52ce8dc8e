"""Quality classifier: naive Bayes support vectors.

Each text is a set of n-gram indicators: byte trigrams, and 1- to 3-grams of
word shapes (case, digits, trailing signs, "same word as before"). Indicators
are hashed into a table, scaled by the log ratio of their smoothed counts in
the two classes, normalised to unit length, and fed to a linear hinge-loss
model that dual coordinate descent fits on a bounded labelled sample. Because
the features are indicators, the fitted model is one weight per table slot:
a score is the sum of the weights of a text's slots, passed through a sigmoid.

Nulls and edge cases: a null text is scored as an empty one; an empty text has
no indicators and gets the sigmoid of the bias. Repeated rows are scored
alike. Of labelled rows that share a doc_id the one whose indicators sort first
is learned from; a doc_id with both labels counts as 1. Without labels of both
classes every score is the share of label 1 (0.5 without any). An empty table
gives no rows. The input's columns come back in the struct ``document``, so
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.hashing import _SPACE, WINDOW_BASES, binaries, groups, hash_windows, hash_words, mix, slices
from tallyspark.llm.shared import bounded_sample

BITS = 16
SLOTS = 1 << (BITS + 1)  #: half for byte trigrams, half for shape n-grams
SAMPLE = 3000  #: labelled texts of each class that the model is fitted on, at most
_KIND = np.zeros(256, np.uint8)  # 0 other sign, 1 lower case or beyond ASCII, 2 upper case, 3 digit
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3


@dataclass
class Model:
    weights: np.ndarray  #: float32, of each slot
    squares: np.ndarray  #: float32, of each slot the square of its scale
    bias: float

    def score(self, slots: np.ndarray) -> float:
        length = np.sqrt(float(self.squares[slots].sum(dtype=np.float64)) + 1.0)
        margin = (float(self.weights[slots].sum(dtype=np.float64)) + self.bias) / length
        return float(1.0 / (1.0 + np.exp(-4.0 * margin)))


def slots_of(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The distinct table slots of each text."""
    for start, end in groups(texts):
        part = texts[start:end]
        joined = b"\n".join(part) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        wide = data.astype(np.uint32)
        tri = np.zeros(len(data), np.uint32)
        if len(data) > 2:
            tri[:-2] = ((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
        words = hash_words(part)
        space = _SPACE[data]
        first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
        after = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
        kind = _KIND[data]
        shape = np.zeros(len(first), np.uint64)
        if len(first):
            signs = np.concatenate(([0], np.cumsum(kind == 0)))
            upper = np.concatenate(([0], np.cumsum(kind == 2)))
            digit = np.concatenate(([0], np.cumsum(kind == 3)))
            n = after - first
            # first kind, last byte if a sign, all-caps, digits, signs only, number of signs, repeated word
            last = data[after - 1]
            shape = kind[first].astype(np.uint64)
            shape |= np.where(kind[after - 1] == 0, last, 0).astype(np.uint64) << np.uint64(2)
            n_sign, n_upper = signs[after] - signs[first], upper[after] - upper[first]
            shape |= ((n_upper > 1) & (n_upper + n_sign == n)).astype(np.uint64) << np.uint64(10)
            shape |= (digit[after] > digit[first]).astype(np.uint64) << np.uint64(11)
            shape |= np.minimum(n_sign, 3).astype(np.uint64) << np.uint64(12)
            shape |= (n_sign == n).astype(np.uint64) << np.uint64(14)
            same = np.concatenate(([False], words.hashes[1:] == words.hashes[:-1]))
            same[words.begin[words.begin < len(same)]] = False
            shape |= same.astype(np.uint64) << np.uint64(15)
        shape = mix(shape + np.uint64(1))
        grams = [shape, hash_windows(shape, 2, WINDOW_BASES[0]), hash_windows(shape, 3, WINDOW_BASES[1])]
        grams = [(g >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS) for g in grams]
        at = 0
        seen = np.zeros(SLOTS, bool)
        for i, text in enumerate(part):
            seen[:] = False
            if len(text) > 2:
                seen[tri[at : at + len(text) - 2]] = True
            for k, g in enumerate(grams):
                seen[g[words.begin[i] : max(words.begin[i], words.end[i] - k)]] = True
            at += len(text) + 1
            yield np.flatnonzero(seen)


def descend(rows: list[np.ndarray], values: np.ndarray, y: np.ndarray, cost: float, rounds: int) -> tuple[np.ndarray, float]:
    """Linear hinge loss by dual coordinate descent; ``values``: the scale of each slot."""
    w = np.zeros(SLOTS)
    bias, alpha = 0.0, np.zeros(len(rows))
    scaled = [values[r] / max(1e-12, np.sqrt(np.square(values[r]).sum() + 1.0)) for r in rows]
    ones = [1.0 / np.sqrt(np.square(values[r]).sum() + 1.0) for r in rows]
    norms = [float(np.square(s).sum()) + o * o for s, o in zip(scaled, ones, strict=True)]
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ scaled[i] + bias * ones[i]) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * scaled[i]
                bias += step * ones[i]
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit_quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, cost: float = 1.0, rounds: int = 20) -> Model:
    """Fit on at most ``sample`` labelled documents of each class.

    ``documents``: doc_id, text. ``labels``: doc_id, label (0 or 1).
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = bounded_sample(known, "doc_id", ["label"], sample)
    # At most 2 x sample ids: a bounded broadcast, and texts are not shuffled.
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = own.join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))), "doc_id")
    texts = texts.select("doc_id", "label", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            slots = [s.astype(np.int32).tobytes() for s in slots_of([t or b"" for t in binaries(batch["text"])])]
            yield pa.record_batch([batch["doc_id"], batch["label"], pa.array(slots, pa.binary())], ["doc_id", "label", "slots"])

    # One row for each id, however often the table repeats it: what reaches the driver is bounded.
    kept = texts.mapInArrow(features, "doc_id long, label int, slots binary").groupBy("doc_id").agg(F.min(F.struct("slots", "label")).alias("r"))
    kept = kept.select("doc_id", "r.*").toPandas().sort_values("doc_id")
    rows = [np.frombuffer(s, np.int32) for s in kept["slots"]]
    y = np.where(kept["label"].to_numpy() == 1, 1.0, -1.0)
    if not len(y) or abs(y.sum()) == len(y):
        share = 0.5 if not len(y) else float(y[0] > 0)
        return Model(np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32), 0.0 if not len(y) else (50.0 if share else -50.0))
    counts = np.ones((2, SLOTS))
    for r, sign in zip(rows, y, strict=True):
        counts[int(sign > 0), r] += 1
    # A class's counts are over its own number of texts, so unequal classes don't shift the ratio.
    p, q = counts[1] / (1 + (y > 0).sum()), counts[0] / (1 + (y < 0).sum())
    ratio = np.log(p) - np.log(q)
    w, bias = descend(rows, ratio, y, cost, rounds)
    return Model((w * ratio).astype(np.float32), np.square(ratio).astype(np.float32), bias)


def score_quality(documents: DataFrame, model: Model) -> DataFrame:
    """document (struct of all input columns) and score of each row."""
    rows = documents.select(F.struct("*").alias("document"), "text")
    schema = T.StructType([rows.schema["document"], T.StructField("score", T.DoubleType())])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in slices(batches):
            out = [fitted.score(slots) for slots in slots_of([t or b"" for t in binaries(batch["text"])])]
            yield pa.record_batch([batch["document"], pa.array(out, pa.float64())], ["document", "score"])

    return rows.mapInArrow(score, schema)
