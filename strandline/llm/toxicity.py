"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, word pairs and pairs with one word between
(lower-cased words of letters, digits and other than ASCII characters), and of the
stems of words: their first ``STEMS`` bytes, where they are longer, as compounds are mostly
words that no labelled row has. All are hashed to ``2**BITS_`` slots. FTRL-proximal keeps a rate for each coordinate, and its L1
term leaves most weights at exactly zero; what is broadcast is the short list of
the others, at most ``2**BITS_`` whatever the corpus.

The model is fitted on a sample of at most ``SAMPLE`` labelled documents, none of
them held out. Scores cover every row and its whole text.

Defined results: null texts are empty; a text without known features has the
intercept's score; without labelled rows every score is 0.5 at no weights;
repeated rows have equal scores; a null id isn't held out as its crc32 is that
of empty text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .common import held_out, table
from .labelled import training_rows

BITS_ = 18
STEMS = (4, 5, 6, 8)
#: Most labelled documents used for fitting, and passes over them.
SAMPLE = 16_000
EPOCHS = 6
CUT = 0.3


def _hashed(t: tx.Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """(text, slot) arrays for single words, pairs, skip pairs and stems, repeats included."""
    w, lower = tx.words(t, tx.ALNUM), tx.LOWER[t.data]
    h = tx.hashes(lower, w.start, w.end)
    owner = w.text()
    out = [(owner, h)]
    for size in STEMS:
        long = w.end - w.start > size
        out.append((owner[long], tx.mix(tx.hashes(lower, w.start[long], w.start[long] + size) + np.uint64(size))))
    for gap in (1, 2):
        g, place = tx.grams(h, w.first, 2, gap, salt=gap)
        out.append((owner[place], g))
    return [(o, (g >> np.uint64(64 - BITS_)).astype(np.int64)) for o, g in out]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def features_of(text: pa.Array) -> pa.Array:
    """The distinct slots of each text."""
    sizes, slots = [], []
    for _, _, t in tx.chunks(text):
        n = len(t.offsets) - 1
        key = np.unique(np.concatenate([(o << BITS_) | s for o, s in _hashed(t)]))
        sizes.append(np.bincount(key >> BITS_, minlength=n))
        slots.append(key & ((1 << BITS_) - 1))
    if not sizes:
        return pa.array([], pa.list_(pa.int32()))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(slots).astype(np.int32)))


def ftrl(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept. FTRL-proximal with a rate for each coordinate (McMahan et al., 2013); rows are sets of slots."""
    size = 1 << BITS_
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    strength = np.full(size + 1, l1)
    strength[size] = 0.0  # the intercept isn't penalised
    order = np.arange(len(y))
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(order):
            at = np.append(rows[i], size)
            za, na, la = z[at], n[at], strength[at]
            root = np.sqrt(na)
            w = -np.sign(za) * np.maximum(np.abs(za) - la, 0) / ((beta + root) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[i]
            z[at] = za + g - (np.sqrt(na + g * g) - root) / alpha * w
            n[at] = na + g * g
    w = -np.sign(z) * np.maximum(np.abs(z) - strength, 0) / ((beta + np.sqrt(n)) / alpha + l2)
    return w[:size], float(w[size])


Model = tuple[np.ndarray, np.ndarray, float]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> Model:
    """(slots, weights, intercept) with the slots whose weight isn't zero.

    Features are made where the documents are; one task takes the sample's steps, as
    each depends on the last, and only its short list of weights comes to the driver.
    """

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, size, slots = [], [], [], []
        for b in batches:
            x = b.column("x")
            ids.append(b.column("doc_id").to_numpy())
            y.append(b.column("y").to_numpy())
            size.append(np.diff(x.offsets.to_numpy()))
            slots.append(x.flatten().to_numpy())
        if not ids:
            return
        ids, y, size, slots = map(np.concatenate, (ids, y, size, slots))
        begin = np.concatenate([[0], np.cumsum(size)])
        order = np.lexsort((size, ids))  # the same order however Spark deals the rows
        w, b = ftrl([slots[begin[i] : begin[i + 1]] for i in order], y[order].astype(float), epochs=epochs)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()]), pa.array([w[at].tobytes()]), pa.array([b])], ["at", "w", "b"])

    rows = training_rows(docs, labels, "toxic", sample).select("doc_id", "y", features_of("text").alias("x"))
    got = rows.repartition(1).mapInArrow(train, "at binary, w binary, b double").collect()
    if not got:
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return np.frombuffer(got[0]["at"], np.int64), np.frombuffer(got[0]["w"]), float(got[0]["b"])


def scorer(model: Model):
    """An Arrow function from texts to scores."""
    at, weights, b = model

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        w = np.zeros(1 << BITS_)
        w[at] = weights
        some = w != 0
        out = []
        for _, _, t in tx.chunks(text):
            key = [(o[m] << BITS_) | s[m] for o, s in _hashed(t) if (m := some[s]).any()]
            key = np.unique(np.concatenate(key)) if key else np.zeros(0, np.int64)
            total = np.bincount(key >> BITS_, w[key & ((1 << BITS_) - 1)], len(t.offsets) - 1)
            out.append(1 / (1 + np.exp(-np.clip(total + b, -35, 35))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text") -> Column:
    """A column of scores for ``docs``, from a model fitted on its labelled rows."""
    return scorer(fit(docs, labels))(F.col(text))


def without_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of score under ``cut``, with all their columns."""
    return docs.where(toxicity(docs, labels) < cut)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), toxicity(docs, labels).alias("score"))
    return scored.select("*", (F.col("score") >= CUT).cast("int").alias("predicted"))
