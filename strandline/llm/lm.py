"""Scoring documents with a recurrent language model and the whole corpus's word counts.

What is counted and learned covers all documents that aren't held out, and every
document is scored to its end. The frequent words of the recurrent part (see
``gru``) are chosen by their counts over those documents. Its weights are fitted on
all of them in rounds: every document falls into one round by a hash, each
partition goes on from the common weights over its documents of the round, and the
partitions' weights are averaged by their tokens. What is broadcast (the model) has
a fixed size, as has what the driver averages.

Counts never leave the executors but for the commonest words. Words are 64-bit hashes.
A reader gives each block's distinct words with their counts, and Spark adds them up by
word. The words over a count that at most ``COMMON`` reach are broadcast with their
counts (a size fixed here, not by the corpus), so a document's sum of log10(c + 0.5) is
computed where its text is, but for the rarer words in it. Those go to the totals as one
row per document and distinct rarer word, and no key among them is hot: a word under that
count stands for less than 1 / ``COMMON`` of the corpus. Rows are told apart by a number
that is written with them, not by a hash.

Defined results: a null text is empty; an empty text is its end mark alone; a
null id's crc32 is that of empty text; without training documents N, V and c are
zero; repeated rows are counted and scored each; other columns are ignored; no
rows give no rows.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import gru
from . import textops as tx
from .common import cut, held_out, table

ROUNDS = 4
#: A partition fits about so many tokens at a time.
FIT_TOKENS = 1 << 19
#: Corpora of fewer documents are gone through several times, as far as this many are met (``gru.EPOCHS`` times at most).
LEAST_DOCUMENTS = 6000
RATE = 0.01
#: Weights averaged in one group; there are two levels of groups.
FAN = 64
MOD, REST = 5, 1
#: Bytes of text whose words are counted together.
BLOCK_BYTES = 1 << 22
#: Words that are broadcast with their counts, at most: 16 bytes each.
COMMON = 1 << 18
#: Thresholds of counts that are tried, for each doubling.
STEPS = 16


_WEIGHTS = "place int, tokens long, weights binary"


def averaged(rows: Iterable) -> tuple[int, dict[str, np.ndarray]]:
    """Tokens, and the mean by tokens of (place, tokens, weights) rows, in order of their places."""
    total, p = 0, {}
    for _, n, weights in sorted(rows, key=lambda r: r[0]):
        total += n
        for k, a in pickle.loads(weights).items():
            p[k] = p.get(k, 0) + a.astype(np.float64) * n
    return total, {k: (a / total).astype(np.float32) for k, a in p.items()}


def one_round(docs: DataFrame, model: gru.Model, r: int, rounds: int, epochs: int) -> DataFrame:
    """Weights after round ``r`` with the tokens they were fitted on, averaged over ``FAN`` times ``FAN`` neighbouring partitions a row."""
    rate = RATE * (1 - r / rounds)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, moments, held, size, seen = copy.deepcopy(model), [], [], 0, 0
        for batch in batches:
            for i, j, _ in tx.chunks(batch.column("text")):
                ids, first = token_ids(batch.column("text").slice(i, j - i), mine.v)
                held += [ids[a:b] for a, b in zip(first[:-1], first[1:])]
                size += len(ids)
                if size >= FIT_TOKENS:
                    mine.fit(held, epochs, rate, moments=moments)
                    held, size, seen = [], 0, seen + size
        if held:
            mine.fit(held, epochs, rate, moments=moments)
        if seen + size:
            row = [TaskContext.get().partitionId()], [seen + size], [pickle.dumps(mine.p)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.int64(), pa.binary()))], ["place", "tokens", "weights"])

    def average(rows: pd.DataFrame) -> pd.DataFrame:
        n, p = averaged(rows[["place", "tokens", "weights"]].itertuples(index=False))
        return pd.DataFrame({"place": [int(rows["place"].min())], "tokens": [n], "weights": [pickle.dumps(p)]})

    part = docs.where(F.col("train") & (F.pmod("key", F.lit(rounds)) == r)).select("text").mapInArrow(train, _WEIGHTS)
    for size in (FAN, FAN * FAN):
        part = part.groupBy(F.floor(F.col("place") / size).alias("to")).applyInPandas(average, _WEIGHTS)
    return part


def fit(docs: DataFrame, v: gru.Vocabulary, documents: int, rounds: int = ROUNDS) -> gru.Model:
    """The recurrent model, from all rows with ``train``, of which there are ``documents``.

    Workers have one BLAS thread, which suits small matrices.
    """
    model = gru.Model(v)
    epochs = min(gru.EPOCHS, max(1, -(-LEAST_DOCUMENTS // max(documents, 1))))
    for r in range(rounds if documents else 0):
        got = one_round(docs, model, r, rounds, epochs).collect()
        if got:
            model.p = averaged(got)[1]
    return model


def token_ids(texts: pa.Array | pa.ChunkedArray, v: gru.Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts' tokens, and where each text begins (n+1)."""
    ids, first, at = [], [np.zeros(1, np.int64)], 0
    for _, _, t in tx.chunks(texts):
        w, h, rare = gru.words_of(t)
        i, f = gru.with_ends(v.ids(h, rare), w.first, v.end)
        ids.append(i)
        first.append(f[1:] + at)
        at += len(i)
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.concatenate(first)


_COUNTS = "word long, rare int, seen long, n long"


def block_counts(docs: DataFrame) -> DataFrame:
    """For each block of texts its distinct words: class as a rare one, count in training documents, count in all."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = np.asarray(batch.column("train").to_pylist(), bool)
            for i, j, _ in tx.chunks(batch.column("text"), BLOCK_BYTES):
                got = []
                for a, _, t in tx.chunks(batch.column("text").slice(i, j - i)):
                    w, h, rare = gru.words_of(t)
                    got.append((h, rare, train[i + a + w.text()]))
                h, rare, flag = map(np.concatenate, zip(*got))
                order = np.argsort(h)
                h, flag = h[order], flag[order]
                lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
                seen = np.add.reduceat(flag, lead, dtype=np.int64) if len(h) else lead
                columns = h[lead].view(np.int64), rare[order[lead]].astype(np.int32), seen, np.diff(np.append(lead, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "rare", "seen", "n"])

    return docs.select("train", "text").mapInArrow(read, _COUNTS)


def totals_of(docs: DataFrame) -> DataFrame:
    """Every word's counts over all blocks, fixed in the checkpoint folder."""
    return cut(block_counts(docs).groupBy("word").agg(F.max("rare").alias("rare"), F.sum("seen").alias("seen"), F.sum("n").alias("n")))


class Common(NamedTuple):
    """The commonest words by hash (ascending): classes as rare ones, and counts in training documents."""

    words: np.ndarray
    rare: np.ndarray
    seen: np.ndarray

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words are, and whether they are there."""
        if not len(self.words):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return at, self.words[at] == h


def common_words(totals: DataFrame, most: int = COMMON) -> Common:
    """All words from the lowest count on that at most ``most`` words reach (of ``STEPS`` counts to a doubling)."""
    step = F.floor(F.log2(F.col("n")) * STEPS).cast("int")
    sizes = sorted(totals.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect(), reverse=True)  # some 64 * STEPS rows
    least, total = None, 0
    for at, words in sizes:
        total += words
        if total > most:
            break
        least = at
    if least is None:
        return Common(np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64))
    got = totals.where(step >= least).select("word", "rare", "seen").toArrow()
    word = got["word"].to_numpy().view(np.uint64)
    order = np.argsort(word)
    return Common(word[order], got["rare"].to_numpy()[order].astype(np.uint8), got["seen"].to_numpy()[order])


def vocabulary(common: Common, documents: int) -> gru.Vocabulary:
    """The ``FREQUENT`` commonest words of the training documents."""
    top = np.lexsort((common.words, -common.seen))[: gru.FREQUENT]
    top = np.sort(top[common.seen[top] > 0])
    return gru.vocabulary_of(common.words[top], common.seen[top], documents)


_READ = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n", "known")]
    + [T.StructField(c, T.DoubleType()) for c in ("base", "rare", "model")]
    + [T.StructField("words", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))]
)


def reader(model: gru.Model, common: Common, rare_mass: np.ndarray):
    """An Arrow function from texts to what can be said of them here, and the rarer words that are left with their counts.

    ``base`` and ``rare`` are sums of log10(c + 0.5) over common words, all of them and those that aren't frequent; ``model``
    has the network's part, with the masses of the classes of rare words taken off.
    """
    log = np.log10(common.seen + 0.5)
    other_log = np.where(np.isin(common.words, model.v.hashes), 0.0, log)
    met = common.seen > 0
    frequent = common.places(model.v.hashes)[0]

    @F.arrow_udf(_READ)
    def read(text: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in range(4)]
        tokens, words, times, sizes = [], [], [], []
        for _, _, t in tx.chunks(text):
            w, h, rare = gru.words_of(t)
            word_ids = model.v.ids(h, rare)
            ids, first = gru.with_ends(word_ids, w.first, model.v.end)
            n_text, owner = len(w.first) - 1, w.text()
            tokens.append(ids)
            # frequent words are common ones, so only others are looked up
            here = word_ids < model.v.end
            at = np.append(frequent, 0)[np.minimum(word_ids, model.v.end)]
            rest = np.flatnonzero(~here)
            at[rest], here[rest] = common.places(h[rest])
            o, a = owner[here], at[here]
            columns[0].append(np.diff(first))
            columns[1].append(np.bincount(o, met[a], n_text).astype(np.int64))
            columns[2].append(np.bincount(o, log[a], n_text))
            columns[3].append(np.bincount(o, other_log[a], n_text))
            o, left = owner[~here], h[~here]
            order = np.lexsort((left, o))
            o, left = o[order], left[order]
            lead = np.ones(len(o), bool)
            lead[1:] = (o[1:] != o[:-1]) | (left[1:] != left[:-1])
            lead = np.flatnonzero(lead)
            words.append(left[lead].view(np.int64))
            times.append(np.diff(np.append(lead, len(o))).astype(np.int32))
            sizes.append(np.bincount(o[lead], minlength=n_text))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        # all texts step together, so few steps have few of them
        ids, first = join(tokens, np.int64), np.concatenate([[0], np.cumsum(join(columns[0], np.int64))])
        mass = np.concatenate([[0.0], np.cumsum(np.append(rare_mass, 0.0)[np.maximum(ids - (model.v.end + 1), -1)])])
        columns.append([model.score(ids, first) - (mass[first[1:]] - mass[first[:-1]])])
        offsets = pa.array(np.concatenate([[0], np.cumsum(join(sizes, np.int64))]).astype(np.int32))
        arrays = [pa.array(join(c, k)) for c, k in zip(columns, (np.int64, np.int64, float, float, float))]
        arrays += [pa.ListArray.from_arrays(offsets, pa.array(join(c, k))) for c, k in ((words, np.int64), (times, np.int32))]
        return pa.StructArray.from_arrays(arrays, _READ.names)

    return read


def scored(docs: DataFrame, rounds: int = ROUNDS, most: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    d = docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        held_out("doc_id", MOD, REST).alias("held_out"),
    )
    d = d.withColumns({"train": ~F.col("held_out"), "key": F.xxhash64("doc_id", "text")})
    totals = totals_of(d)
    common = common_words(totals, most)
    ends = d.where("train").count()
    model = fit(d, vocabulary(common, ends), ends, rounds)

    # tokens and distinct words of the training documents: all, and of those that aren't frequent by class
    met = F.sum((F.col("seen") > 0).cast("long"))
    stats = totals.groupBy("rare").agg(F.sum("seen").alias("n"), met.alias("v")).collect()  # a row for each class
    often = dict.fromkeys(range(gru.RARE), (0, 0))
    frequent = np.isin(common.words, model.v.hashes)
    for kind, seen in zip(common.rare[frequent].tolist(), common.seen[frequent].tolist()):
        often[kind] = often[kind][0] + seen, often[kind][1] + 1
    rare_mass = np.full(gru.RARE, np.log10(0.5))
    for kind, n, v in stats:
        rare_mass[kind] = np.log10(n - often[kind][0] + 0.5 * (v - often[kind][1] + 1))
    all_tokens, distinct = sum(r["n"] for r in stats) + ends, sum(r["v"] for r in stats) + (ends > 0)
    base_mass = float(np.log10(all_tokens + 0.5 * (distinct + 1)))

    rows = d.select("doc_id", "held_out", reader(model, common, rare_mass)("text").alias("r"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    left = rows.select("row", F.explode(F.arrays_zip(F.col("r.words").alias("word"), F.col("r.times").alias("times"))).alias("x")).select("row", "x.word", "x.times")
    count = F.coalesce("seen", F.lit(0))
    sums = (
        left.join(totals.where("seen > 0").select("word", "seen"), "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(count + 0.5)).alias("more"), F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("more_known"))
    )
    end = float(np.log10(ends + 0.5))
    more, more_known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    return rows.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        F.col("r.n").alias("n_tokens"),
        (F.col("r.known") + more_known + int(ends > 0)).alias("n_known"),
        F.lit(int(all_tokens)).cast("long").alias("train_tokens"),
        (F.col("r.base") + more + end - F.col("r.n") * base_mass).alias("base_score"),
        (F.col("r.model") + F.col("r.rare") + more).alias("score"),
    )


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
