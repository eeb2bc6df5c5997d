"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block`` documents. Ideally all sources that
last are read at once, each at the rate of its weight over the sum of theirs, one
block a slot in all. In this ideal, block i of a source begins and ends at certain
times; rounded down and up they are the block's release and deadline. Each slot
goes to the released block that is due first. As the ideal reads one block a slot,
every block keeps its window, so at every slot each source has received what its
target weight gives it to within less than one block, also where others end (Baruah
et al., 1996).

Rounds of ``period`` slots (or of the widest window, if that is more) are scheduled
apart, in tasks. For that, ``done_by`` tells which blocks the one schedule over all
has placed before a slot, without running it up to there: those that are due by then, and of those
whose windows reach past it the first due ones for which slots were left after
their release. Weights are never rounded. Times are doubles, and windows are taken wider by
a millionth of a slot and 1e-14 of the time, so that no rounding of these can close one.

Driver and tasks hold two numbers and the name of each source, of ``MOST_SOURCES``
at most (more are refused); blocks and documents only occur as rows.

Numbering the documents of a source takes no task with all of a source: they
fall into buckets of some ``BUCKET`` rows by a hash (copies of one row by the part of
the input that they're in), are numbered there, and the sizes of the buckets before
are added. Slots come to the documents by bucket too, so rows are dealt once.

Defined results: a null source is a source of its own; sources of no or zero
weight follow when the others have ended, with equal weights; repeated rows are
placed each; null ids, empty and very long texts don't matter; no rows give no rows;
other columns stay, also such as have the names used here.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

BLOCK = 16
PERIOD = 4096
#: Slots of a round at most: what a task schedules at once. Narrower than the widest window, it only costs a longer look back.
LONGEST = 1 << 20
#: Rounds that a task runs one after another.
ROUNDS = 64
MOST_SOURCES = 1 << 20
BUCKET = 1024
#: Rows of the first level of running sums.
RUN = 4096
#: Default target weights are sizes to this power: large sources are held back, small ones come sooner.
TEMPER = 0.5


class Ideal:
    """The ideal: all sources that last are read at once, by weight. Times are in slots."""

    def __init__(self, weight: np.ndarray, blocks: np.ndarray):
        self.weight, self.blocks = weight.astype(np.float64), blocks.astype(np.int64)
        # in virtual time each source is read at the rate of its weight until it ends
        end = self.blocks / self.weight
        order = np.argsort(end, kind="stable")
        rate = self.weight.sum() - np.append(0.0, np.cumsum(self.weight[order])[:-1])
        self.virtual = np.append(0.0, end[order])
        self.slots = np.append(0.0, np.cumsum(np.maximum(rate, self.weight[order]) * np.diff(self.virtual)))
        self.total = int(self.blocks.sum())

    def _when(self, source: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.interp(n / self.weight[source], self.virtual, self.slots)

    def release(self, source: np.ndarray, i: np.ndarray) -> np.ndarray:
        t = self._when(source, i)
        return np.floor(t + 1e-6 + 1e-14 * t).astype(np.int64)

    def deadline(self, source: np.ndarray, i: np.ndarray) -> np.ndarray:
        t = self._when(source, i + 1)
        return np.maximum(np.ceil(t - 1e-6 - 1e-14 * t).astype(np.int64), self.release(source, i) + 1)

    def _first(self, at: int, passed) -> np.ndarray:
        """Of each source the first block that hasn't ``passed``, which holds of a source's blocks up to some one; the ideal at ``at`` is near it."""
        every = np.arange(len(self.weight))
        n = np.clip(np.floor(self.weight * np.interp(at, self.slots, self.virtual)).astype(np.int64), 0, self.blocks)
        while (back := (n > 0) & ~passed(every, np.maximum(n - 1, 0))).any():
            n -= back
        while (on := (n < self.blocks) & passed(every, n)).any():
            n += on
        return n

    def due_by(self, at: int) -> np.ndarray:
        """How many blocks of each source have their deadline by then."""
        return self._first(at, lambda s, i: self.deadline(s, i) <= at)

    def ended_by(self, at: int) -> int:
        """How many sources have ended in the ideal."""
        return int(np.searchsorted(self.slots[1:], at, "right"))

    def done_by(self, at: int) -> np.ndarray:
        """How many blocks of each source earliest deadline first (ties: the source before) has placed in the slots before ``at``.

        Due blocks are all placed. Of the others that are released, one a source, the first
        due one is placed if slots suffice for all placed blocks that are released no sooner, and so on.
        """
        if at >= self.total:
            return self.blocks.copy()
        done = self.due_by(at)
        short = at - int(done.sum())
        open_ = np.flatnonzero(done < self.blocks)
        release = self.release(open_, done[open_])
        open_, release = open_[release < at], release[release < at]
        if short <= 0 or not len(open_):
            return done
        # before the first of their releases the due blocks have all slots they need
        low = int(release.min())
        begin = self._first(low, lambda s, i: self.release(s, i) < low)
        size = np.maximum(done - begin, 0)
        source = np.repeat(np.arange(len(size)), size)
        due = np.sort(self.release(source, np.arange(len(source)) - np.repeat(np.cumsum(size) - size, size) + begin[source])) - low
        # each takes the first free slot from its release on: late slots serve all that come later
        taken = np.maximum.accumulate(due - np.arange(len(due))) + np.arange(len(due))
        free = np.ones(at - low + 1, bool)
        free[taken[taken < at - low]] = False
        after = np.flatnonzero(free)
        after = after[np.searchsorted(after, np.arange(at - low + 1))].tolist()  # the first free slot from each on; the last is none

        def find(x: int) -> int:
            root = x
            while after[root] != root:
                root = after[root]
            while after[x] != root:
                after[x], x = root, after[x]
            return root

        order = np.lexsort((open_, self.deadline(open_, done[open_])))
        left = []
        for s, r in zip(open_[order].tolist(), (release[order] - low).tolist()):
            slot = find(r)
            if slot == at - low:
                left.append(s)
                continue
            after[slot] = slot + 1
            done[s] += 1
            short -= 1
            if not short:
                break
        for s in left[: max(short, 0)]:  # only if doubles were too coarse
            done[s] += 1
        return done

    def blocks_of(self, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(source, block) of the blocks that lie between two states."""
        size = after - before
        source = np.repeat(np.arange(len(size)), size)
        return source, np.arange(len(source)) - np.repeat(np.cumsum(size) - size, size) + before[source]

    def widest(self) -> int:
        """Slots in the widest window: rates only rise, so the lightest source has it."""
        return int(np.ceil(self.weight.sum() / self.weight.min())) + 1


def windows(weight: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all blocks, source by source: their source, release and deadline."""
    ideal = Ideal(weight, blocks)
    source, i = ideal.blocks_of(np.zeros(len(blocks), np.int64), ideal.blocks)
    return source, ideal.release(source, i), ideal.deadline(source, i)


def first_due(release: np.ndarray, deadline: np.ndarray) -> np.ndarray:
    """The slot of each block: earliest deadline first (ties: the block before) among released blocks; if none is, the next to be."""
    n = len(release)
    order, slots = np.argsort(release, kind="stable").tolist(), np.empty(n, np.int64)
    begin, due = release.tolist(), deadline.tolist()
    ready: list[tuple[int, int]] = []
    at = 0
    for t in range(n):
        while at < n and (begin[order[at]] <= t or not ready):
            heapq.heappush(ready, (due[order[at]], order[at]))
            at += 1
        slots[heapq.heappop(ready)[1]] = t
    return slots


_KEY = "__mix_key"
_PLAN = f"{_KEY} string, block long, phase long, slot long, release long, deadline long"


def _running(d: DataFrame, value: str, by: list[str], at: str, name: str) -> DataFrame:
    """With the sum of ``value`` over the rows before (by ``at``) in two levels, so no task has all of a key."""
    run = F.floor(F.col(at) / RUN)
    sums = d.groupBy(*by, run.alias("__run")).agg(F.sum(value).alias("__sum"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "__run", before("__sum", Window.partitionBy(*by).orderBy("__run")).alias("__base"))
    inside = d.withColumn("__run", run).withColumn(name, before(value, Window.partitionBy(*by, "__run").orderBy(at)))
    return inside.join(sums, [*by, "__run"]).withColumn(name, F.col(name) + F.col("__base")).drop("__run", "__base")


def schedule(sources: DataFrame, period: int = PERIOD) -> DataFrame:
    """``_PLAN`` rows, one for each block of (source_key, late, weight, blocks) rows; phase is the number of sources that end before its round. Late sources follow the others."""
    spark = sources.sparkSession
    held = sources.orderBy("late", "source_key").limit(MOST_SOURCES + 1).toArrow()
    if len(held) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    late = held.column("late").to_numpy(zero_copy_only=False)
    weight, blocks, keys = held.column("weight").to_numpy(), held.column("blocks").to_numpy(), held.column("source_key")
    plans, base = [], 0
    for part in (np.flatnonzero(~late), np.flatnonzero(late)):
        if not len(part):
            continue
        ideal, names = Ideal(weight[part], blocks[part]), keys.take(pa.array(part)).combine_chunks()
        length = min(max(period, min(ideal.widest(), LONGEST)), ideal.total)

        def rounds(batches: Iterator[pa.RecordBatch], ideal=ideal, names=names, length=length, base=base) -> Iterator[pa.RecordBatch]:
            last, state = None, None
            for batch in batches:
                for r in batch.column(0).to_pylist():
                    at, to = r * length, min((r + 1) * length, ideal.total)
                    before = state if last == r - 1 and state is not None else ideal.done_by(at)
                    last, state = r, ideal.done_by(to)
                    source, i = ideal.blocks_of(before, state)
                    release, deadline = ideal.release(source, i), ideal.deadline(source, i)
                    slot = first_due(np.maximum(release - at, 0), deadline - at) + at
                    phase = np.full(len(i), ideal.ended_by(at))
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(source)), *map(pa.array, (i, phase, slot + base, release + base, deadline + base))], [_KEY, "block", "phase", "slot", "release", "deadline"]
                    )

        n = -(-ideal.total // length)
        plans.append(spark.range(0, n, 1, max(1, min(n, 1 + n // ROUNDS + spark.sparkContext.defaultParallelism))).mapInArrow(rounds, _PLAN))
        base += ideal.total
    return plans[0] if len(plans) == 1 else plans[0].unionByName(plans[1])


def _key(c: Column) -> Column:
    return F.concat(F.when(c.isNull(), "0").otherwise("1"), F.coalesce(c.cast("string"), F.lit("")))


def mixed(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """The rows with a struct column ``__mix``: block, phase (sources that ended before its round), slot, release, deadline (slots of the whole mixture) and position."""
    spark = docs.sparkSession
    # a row's hash orders the rows of its source; which of several equal rows comes first doesn't matter
    salt = F.xxhash64("doc_id", "text") if "text" in docs.columns else F.xxhash64("doc_id")
    d = docs.withColumn(_KEY, _key(F.col("source"))).withColumn("__mix_salt", salt)
    largest = d.groupBy(_KEY).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    n_buckets = max(1, -(-largest // BUCKET))
    d = d.withColumn("__mix_bucket", F.pmod(F.xxhash64("__mix_salt", F.spark_partition_id()), F.lit(n_buckets)))
    buckets = cut(d.groupBy(_KEY, "__mix_bucket").agg(F.count("*").alias("n")))

    sizes = buckets.groupBy(_KEY).agg(F.sum("n").alias("n"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("n", F.lit(TEMPER)))
    else:
        given = [("0" if k is None else "1" + str(k), float(w)) for k, w in weights.items()]
        sizes = sizes.join(spark.createDataFrame(given, f"{_KEY} string, weight double"), _KEY, "left")
    late = F.coalesce("weight", F.lit(0.0)) <= 0
    sources = sizes.select(F.col(_KEY).alias("source_key"), late.alias("late"), F.when(late, 1.0).otherwise(F.col("weight")).alias("weight"), F.ceil(F.col("n") / block).alias("blocks"))
    if sources.isEmpty():
        return docs.withColumn("__mix", F.lit(None).cast("struct<block:bigint,phase:bigint,slot:bigint,release:bigint,deadline:bigint,position:bigint>"))
    sources = cut(sources)
    # the blocks of each bucket: some BUCKET / block of them, a row each
    before = _running(buckets, "n", [_KEY], "__mix_bucket", "before")
    mine = before.select(_KEY, "__mix_bucket", "before", F.explode(F.sequence(F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("n") - 1) / block))).alias("block"))
    mine = mine.join(schedule(sources, period), [_KEY, "block"])
    place = F.struct("block", "phase", "slot", "release", "deadline")
    places = mine.groupBy(_KEY, "__mix_bucket").agg(F.first("before").alias("__mix_before"), F.sort_array(F.collect_list(place)).alias("__mix_places"))

    inside = Window.partitionBy(_KEY, "__mix_bucket").orderBy("__mix_salt", "doc_id")
    d = d.withColumn("__mix_n", F.row_number().over(inside) - 1).join(places, [_KEY, "__mix_bucket"])
    n = F.col("__mix_n") + F.col("__mix_before")
    p = F.get("__mix_places", (F.floor(n / block) - F.floor(F.col("__mix_before") / block)).cast("int"))
    mix = F.struct(
        *(p[c].alias(c) for c in ("block", "phase", "slot", "release", "deadline")),
        (p["slot"] * block + F.pmod(n, F.lit(block))).alias("position"),
    )
    return d.select(*(F.col(f"`{c}`") for c in docs.columns), mix.alias("__mix"))


def interleaved(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """The documents in the order of the mixture: files written from it hold consecutive positions."""
    return mixed(docs, weights, block).repartitionByRange("__mix.position").sortWithinPartitions("__mix.position").drop("__mix")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return m.select("doc_id", "source", *(F.col(f"__mix.{c}").alias(c) for c in ("block", "phase", "slot", "release", "deadline", "position")))
