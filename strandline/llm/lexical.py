"""Ranked lexical search by variable block-max WAND.

Each document's counts of the terms that the queries hold are laid out once, as arrays
in its row. A shard is a run of a task's documents; its posting lists are cut into blocks
of variable length, and dynamic programming chooses the cuts: a block's bound is the
largest score in it, so its error is the sum of what its postings lie below that
bound, and the cuts minimise all errors plus ``COST`` for each block (Mallia et al.,
2017, whose search for the cuts is by approximation).

A query is answered per shard. The bounds of its terms' blocks are added up along the
shard's documents. As in WAND, a document can only be a pivot where this sum
reaches the threshold, the score of the k-th best found so far; the stretches between
block ends are taken in order of their bounds, the postings of blocks that have a pivot
are read and added up, all others are skipped. The search ends when no bound left
reaches the threshold, so what it gives is exact. A task keeps its k best from shard to
shard, and Spark merges the tasks' best.

Queries are taken in blocks of some ``TERMS`` different terms, and each block's terms and
weights are what tasks are sent. A shard is closed at ``SHARD`` documents or
``POSTINGS`` postings, so a task holds no more than that, whatever a partition holds.

Defined results: a null text has no term, neither in a document nor in an item; items
without terms and documents that share none give no rows; items that repeat both id
and text are one; rows of one item_id with other texts are ranked apart; repeated
documents are ranked each; equal scores go by doc_id, null last; other columns are
ignored; no documents or no items give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import textops as tx
from .common import cut, table

TOP = 10
SHARD = 16384
POSTINGS = 1 << 22
#: Different terms of queries that are answered at once: bounds what tasks are sent.
TERMS = 1 << 17
#: Postings of a block at most, and what a block costs, as a share of its list's mean score.
LONGEST = 64
COST = 1.0

_COUNTS = "doc_id long, n long, terms array<int>, tf array<int>"
_FOUND = "item int, doc_id long, score long"


def tokens(t: tx.Texts) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, A-Z lower-cased, and the text of each."""
    w = tx.words(t, tx.ALNUM)
    size = w.end - w.start
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    body = tx.LOWER[t.data[tx.ALNUM[t.data]]]
    terms = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(body))
    return terms, w.text()


def counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (all terms, with repeats), and the places in ``terms`` (ascending) with the occurrences of those that a document has; documents without any term are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, m = pa.array(terms, pa.large_string()), max(len(terms), 1)
        for batch in batches:
            for a, b, t in tx.chunks(batch.column("text")):
                found, text = tokens(t)
                n = np.bincount(text, minlength=b - a)
                place = pc.index_in(found, known)
                there = place.is_valid().to_numpy(zero_copy_only=False)
                key, tf = np.unique(text[there] * m + place.drop_null().to_numpy(), return_counts=True)
                kept = np.flatnonzero(n)
                first = np.searchsorted(key, np.append(kept, b - a) * m).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x.astype(np.int32))) for x in (key % m, tf)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a).take(pa.array(kept)), pa.array(n[kept].astype(np.int64)), *lists], ["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, _COUNTS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def cuts(score: np.ndarray, first: np.ndarray, longest: int = LONGEST, cost: float = COST) -> np.ndarray:
    """Where blocks begin (and the end) of lists ``score[first[i]:first[i + 1]]``, no block over two lists.

    best[i] = min over lengths b of best[i - b] + b * max(last b scores) + price: the sum
    of all scores is in every choice, so it is left out. All lists take a step at once;
    a ring holds, for each of the last ``longest`` beginnings, its best and its maximum.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    size = size[size > 0]
    begin = begin[: len(size)]
    back = np.ones(len(score), np.int32)
    if not len(size):
        return np.array([0, len(score)])
    total = np.append(0.0, np.cumsum(score, dtype=np.float64))
    price = cost * (total[begin + size] - total[begin]) / size
    best, high = np.full((longest, len(size)), np.inf), np.zeros((longest, len(size)))
    now = np.zeros(len(size))
    age = -np.arange(longest)[:, None]
    for i in range(int(size[0])):
        live = int(np.searchsorted(-size, -i, "left"))  # lists of more than i postings
        s = score[begin[:live] + i]
        at = i % longest
        best[at, :live], high[at, :live] = now[:live], 0
        np.maximum(high[:, :live], s, out=high[:, :live])
        length = (i + age) % longest + 1
        choice = best[:, :live] + length * high[:, :live]
        pick = choice.argmin(axis=0)
        now[:live] = choice[pick, np.arange(live)] + price[:live]
        back[begin[:live] + i] = length[pick, 0]
    # from the ends of the lists back, all at once
    starts, at, low = [], begin + size, begin
    while len(at):
        at = at - back[at - 1]
        starts.append(at)
        more = at > low
        at, low = at[more], low[more]
    return np.append(np.sort(np.concatenate(starts)), len(score))


class Shard(NamedTuple):
    """Posting lists of some documents, by term; places of documents ascend within a list."""

    doc_id: np.ndarray
    null_id: np.ndarray
    doc: np.ndarray
    score: np.ndarray
    first: np.ndarray
    block: np.ndarray
    block_of: np.ndarray
    bound: np.ndarray


def shard(doc_id: np.ndarray, null_id: np.ndarray, m: np.ndarray, n_terms: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray) -> Shard:
    """``m`` and ``n_terms``: of each document; ``terms``, ``tf``: of all, document by document."""
    # from short documents to long ones, so that a block's scores are alike and its bound is near them
    by_size = np.argsort(m, kind="stable")
    place = np.empty(len(by_size), np.int64)
    place[by_size] = np.arange(len(by_size))
    doc = np.repeat(place, n_terms)
    score = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, n_terms)))
    order = np.lexsort((doc, terms))
    doc, score = doc[order], score[order]
    first = np.searchsorted(terms[order], np.arange(len(weights) + 1))
    block = cuts(score, first)
    bound = np.maximum.reduceat(score, block[:-1]) if len(score) else score
    return Shard(doc_id[by_size], null_id[by_size], doc, score, first, block, np.searchsorted(block, first), bound)


def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All of start[i]..end[i] - 1, one after another."""
    size = end - start
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def search(s: Shard, terms: np.ndarray, times: np.ndarray, k: int = TOP, least: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and scores of the k best documents of ``least`` or more, in no order, with others that tie; and how many postings were read."""
    blocks = _spans(s.block_of[terms], s.block_of[terms + 1])
    if not len(blocks):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    repeats = np.repeat(times, s.block_of[terms + 1] - s.block_of[terms])
    lo, hi = s.doc[s.block[blocks]], s.doc[s.block[blocks + 1] - 1] + 1
    n = len(s.doc_id)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, lo, s.bound[blocks] * repeats)
    np.subtract.at(step, hi, s.bound[blocks] * repeats)
    edge = np.flatnonzero(step[:n])
    upper = np.cumsum(step[edge])  # between two edges
    ends = np.append(edge[1:], n)
    got, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    # what the blocks read so far give each document; all of it, once all blocks that hold it are read
    total, unread = np.zeros(n, np.int64), np.ones(len(blocks), bool)
    order = np.argsort(-upper, kind="stable")
    at, width = 0, 8
    while at < len(order) and upper[order[at]] >= least:
        part = order[at : at + width]
        part = part[upper[part] >= least]
        at, width = at + width, width * 2
        pivot = _spans(edge[part], ends[part])
        before = np.zeros(n + 1, np.int64)
        before[pivot + 1] = 1
        np.cumsum(before, out=before)
        wanted = np.flatnonzero(unread & (before[hi] > before[lo]))
        unread[wanted] = False
        start, end = s.block[blocks[wanted]], s.block[blocks[wanted] + 1]
        posting = _spans(start, end)
        np.add.at(total, s.doc[posting], s.score[posting] * np.repeat(repeats[wanted], end - start))
        good = pivot[total[pivot] >= least]
        got, scores = np.append(got, good), np.append(scores, total[good])
        if len(got) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            least = max(least, int(kth))
            got, scores = got[scores >= least], scores[scores >= least]
    size = s.block[blocks + 1] - s.block[blocks]
    return got, scores, int(size[~unread].sum())


def _best(docs: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (place in ``items``), doc_id, score: each task's k best."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each item: scores, whether the id is null, ids
        best = [(np.zeros(0, np.int64),) * 3 for _ in items]
        held: list[pa.RecordBatch] = []

        def close() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            ids, lists = t.column("doc_id").combine_chunks(), t.column("terms").combine_chunks()
            m = 25 + 75 * t.column("n").to_numpy() * n_docs // n_terms
            size = pc.list_value_length(lists).to_numpy()
            terms = pc.list_flatten(lists).to_numpy().astype(np.int64)
            tf = pc.list_flatten(t.column("tf").combine_chunks()).to_numpy().astype(np.int64)
            s = shard(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), m, size, terms, tf, weights)
            for i, (at, times) in enumerate(items):
                old = best[i]
                least = int(old[0].min()) if len(old[0]) >= k else 1
                got, scores, _ = search(s, at, times, k, max(least, 1))
                if len(got):
                    new = [np.append(a, b) for a, b in zip(old, (scores, s.null_id[got], s.doc_id[got]))]
                    first = np.lexsort((new[2], new[1], -new[0]))[:k]
                    best[i] = tuple(x[first] for x in new)

        docs_held = postings = 0
        for batch in batches:
            held.append(batch)
            docs_held += len(batch)
            postings += len(batch.column("terms").values)
            if docs_held >= SHARD or postings >= POSTINGS:
                close()
                docs_held = postings = 0
        if docs_held:
            close()
        for i, (scores, null, ids) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), i, np.int32)), pa.array(ids, mask=null.astype(bool)), pa.array(scores)], ["item", "doc_id", "score"])

    return docs.mapInArrow(found, _FOUND)


def _terms_of(text: str | None) -> dict[str, int]:
    out: dict[str, int] = {}
    for _, _, t in tx.chunks(pa.array([text], pa.string())):
        for x in tokens(t)[0].to_pylist():
            out[x] = out.get(x, 0) + 1
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` highest documents of a score above zero."""
    spark = docs.sparkSession
    asked = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    # a bound on the terms of all items, then as many blocks as that takes
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // (4 * TERMS)))
    results = []
    for b in range(n_blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).orderBy("item_id", "text").toArrow()
        found = [_terms_of(x) for x in rows.column("text").to_pylist()]
        terms = sorted({x for f in found for x in f})
        place = {x: i for i, x in enumerate(terms)}
        each = cut(counts(docs, terms))
        n_docs, n_terms = each.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not terms:
            continue
        holding = each.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # ``terms`` rows at most
        df = np.zeros(len(terms), np.int64)
        df[holding.column("term").to_numpy()] = holding.column("df").to_numpy()
        weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        lists = []
        for f in found:
            at = np.array(sorted(place[x] for x in f), np.int64)
            lists.append((at, np.array([f[terms[i]] for i in at], np.int64)))
        names = spark.createDataFrame([(i, r) for i, r in enumerate(rows.column("item_id").to_pylist())], "item int, item_id long")
        best = _best(each, lists, weights, n_docs, n_terms, k)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        results.append(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The contract's formulas over all pairs of an item and a document that share a term.
SQL = r"""
WITH words AS (
    SELECT rowid AS d, doc_id,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
),
docs AS (SELECT d, doc_id, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM words) GROUP BY d, term),
asked AS (
    SELECT item, item_id, term, count(*) AS times
    FROM (
        SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT DISTINCT item_id, text, hash(item_id, text) AS item FROM benchmark WHERE text IS NOT NULL)
    )
    GROUP BY item, item_id, term
),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term), total
),
scores AS (
    SELECT item, item_id, tf.d, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms))))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN docs USING (d), total
    GROUP BY item, item_id, tf.d, doc_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
