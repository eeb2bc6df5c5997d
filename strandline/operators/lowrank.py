"""Principal axes of any number of nodes: sketches that merge, then rounds of joins where they left something out.

A sketch of some patients is their number, their mean and the ``rank`` leading axes of
what they deviate from it, each scaled by its singular value. Two sketches merge to the sketch
of all their patients: axes are stacked with a row for the distance of the means and cut
to ``rank`` again. Tasks make sketches, a tree of tasks merges them; a task holds ``FAN``
sketches of rank x nodes numbers, and no node-by-node matrix is made anywhere.

A sketch that never had more than ``rank`` axes is exact. One that left some out knows
how much, and its axes are then only the start of a subspace iteration, two joins and
aggregations a round, until the leading variances stand still.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .iterate import cut

#: More axes than wanted are kept: what is left out then matters less.
SPARE = 8
#: Up to so many nodes a sketch keeps as many axes as nodes: then it leaves nothing out, and no round is needed.
WHOLE = 512
#: Patients that a task takes into its sketch at once, and sketches that one task merges.
CHUNK, FAN = 64, 8
#: Rounds at most, and the relative change of variances at which they stop.
ROUNDS, STILL = 60, 1e-12


class Sketch(NamedTuple):
    n: int
    mean: np.ndarray
    axes: np.ndarray
    lost: float


def merged(parts: list[Sketch], rank: int) -> Sketch:
    """The sketch of all patients of some sketches."""
    n, mean = parts[0].n, parts[0].mean
    rows, lost = [parts[0].axes], parts[0].lost
    for p in parts[1:]:
        rows += [p.axes, np.sqrt(n * p.n / (n + p.n)) * (p.mean - mean)[None]]
        mean, n, lost = (n * mean + p.n * p.mean) / (n + p.n), n + p.n, lost + p.lost
    stack = np.vstack(rows)
    if len(stack) > rank:
        _, s, v = np.linalg.svd(stack, full_matrices=False)
        stack, lost = s[:rank, None] * v[:rank], lost + float((s[rank:] ** 2).sum())
    return Sketch(n, mean, stack, lost)


def of_rows(m: np.ndarray, rank: int) -> Sketch:
    mean = m.mean(0)
    return merged([Sketch(len(m), mean, m - mean, 0.0)], rank)


_ROW = "id long, n long, mean binary, axes binary, lost double"


def _pack(at: int, s: Sketch) -> pd.DataFrame:
    return pd.DataFrame({"id": [at], "n": [s.n], "mean": [s.mean.tobytes()], "axes": [s.axes.tobytes()], "lost": [s.lost]})


def _unpack(pdf: pd.DataFrame, width: int) -> list[Sketch]:
    return [Sketch(int(r.n), np.frombuffer(r.mean), np.frombuffer(r.axes).reshape(-1, width), r.lost) for r in pdf.itertuples()]


def sketch(x: DataFrame, rank: int, width: int) -> DataFrame:
    """One ``_ROW`` (none without rows) for (patient_id, node, value), nodes from 0; what isn't there is zero."""
    rows = x.groupBy("patient_id").agg(F.collect_list(F.col("node").cast("int")).alias("node"), F.collect_list(F.col("value").cast("double")).alias("value"))

    def first(batches):
        from pyspark import TaskContext

        own = None
        for pdf in batches:
            for a in range(0, len(pdf), CHUNK):
                part = pdf.iloc[a : a + CHUNK]
                m = np.zeros((len(part), width))
                at = np.repeat(np.arange(len(part)), part["node"].map(len))
                m[at, np.concatenate(part["node"].to_list())] = np.concatenate(part["value"].to_list())
                new = of_rows(m, rank)
                own = new if own is None else merged([own, new], rank)
        if own is not None:
            yield _pack(TaskContext.get().partitionId(), own)

    def together(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack(int(key[0]), merged(_unpack(pdf.sort_values("id"), width), rank))

    s = cut(rows.mapInPandas(first, _ROW))
    while s.count() > 1:
        s = cut(s.groupBy(F.floor(F.col("id") / FAN).alias("to")).applyInPandas(together, _ROW))
    return s


def _products(d: DataFrame, a: str, k: int) -> np.ndarray:
    """Sum over rows of an array column's outer products: a k x k matrix a task goes to the driver."""

    def add(batches):
        total = np.zeros((k, k))
        for pdf in batches:
            if len(pdf):
                m = np.vstack(pdf[a].to_list())
                total += m.T @ m
        yield pd.DataFrame({"p": [total.tobytes()]})

    total = np.zeros((k, k))
    for r in d.select(a).mapInPandas(add, "p binary").toLocalIterator():
        total += np.frombuffer(r["p"]).reshape(k, k)
    return total


def _turned(v: str, by: np.ndarray) -> Column:
    """An array column times a small matrix."""
    return F.array(*(sum((F.col(v)[i] * float(by[i, j]) for i in range(by.shape[0])), F.lit(0.0)) for j in range(by.shape[1])))


def _scores(x: DataFrame, v: DataFrame, means: DataFrame, k: int) -> DataFrame:
    """(patient_id, s): projections of what patients deviate from the mean."""
    shift = means.join(v, "node").agg(F.array(*(F.sum(F.col("mean") * F.col("v")[j]) for j in range(k))).alias("m")).first()["m"]
    d = x.join(v, "node").groupBy("patient_id").agg(F.array(*(F.sum(F.col("value") * F.col("v")[j]) for j in range(k))).alias("s"))
    return d.select("patient_id", F.array(*(F.col("s")[j] - float(shift[j] or 0.0) for j in range(k))).alias("s"))


def axes(x: DataFrame, k: int, spare: int = SPARE) -> tuple[DataFrame, DataFrame, list[float]]:
    """(pc, node, loading), (node, mean) and the shares of all variance of the k leading axes of (patient_id, node, value).

    Nodes without a row have no loading. The largest loading of an axis is positive (ties: the smallest node). Fewer axes than k
    come of fewer patients or nodes; without rows there are none.
    """
    spark = x.sparkSession
    x = x.select("patient_id", F.col("node").cast("int").alias("node"), F.col("value").cast("double").alias("value"))
    row = x.agg(F.max("node"), F.count_distinct("patient_id")).first()
    none = spark.createDataFrame([], "pc int, node int, loading double"), spark.createDataFrame([], "node int, mean double"), []
    if row[0] is None:
        return none
    width, n = int(row[0]) + 1, int(row[1])
    rank = width if width <= WHOLE else k + spare
    s = sketch(x, rank, width)
    lost = s.agg(F.sum("lost")).first()[0]
    sums = x.groupBy("node").agg((F.sum("value") / n).alias("mean"), F.sum(F.col("value") * F.col("value")).alias("sq"))
    total = float(sums.agg(F.sum(F.col("sq") / n - F.col("mean") * F.col("mean"))).first()[0])
    means = cut(sums.select("node", "mean"))

    def start(batches):
        for pdf in batches:
            for one in _unpack(pdf, width):
                _, value, v = np.linalg.svd(one.axes, full_matrices=False)
                live = value > (value[0] if len(value) else 0) * 1e-12
                v, value = v[live], value[live]
                for a in range(0, width, 65536):
                    yield pd.DataFrame({"node": np.arange(a, min(width, a + 65536), dtype=np.int32), "v": [*v[:, a : a + 65536].T.copy()], "size": len(value)})

    v = cut(s.mapInPandas(start, "node int, v array<double>, size int"))
    size = v.agg(F.max("size")).first()[0]
    if not size or total <= 0:
        return none[0], means, []
    v, width_v = v.select("node", "v"), int(size)
    old = None
    for _ in range(ROUNDS):
        score = cut(_scores(x, v, means, width_v))
        c = _products(score, "s", width_v) / n
        value, turn = np.linalg.eigh((c + c.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        top = value[: min(k, width_v)]
        if lost <= 1e-12 * total * n or (old is not None and np.abs(top - old).max() <= STILL * max(top.max(), 1e-300)):
            break
        old = top
        back = cut(x.join(score, "patient_id").groupBy("node").agg(F.array(*(F.sum(F.col("value") * F.col("s")[j]) for j in range(width_v))).alias("v")))
        g, u = np.linalg.eigh(_products(back, "v", width_v))
        keep = g > g.max() * 1e-14
        by = u[:, keep] / np.sqrt(g[keep])
        v, width_v = cut(back.select("node", _turned("v", by).alias("v"))), int(keep.sum())
    kept = min(k, n, width_v)
    load = v.select("node", _turned("v", turn[:, :kept]).alias("v")).select("node", F.posexplode("v").alias("pc", "loading"))
    load = cut(load.select((F.col("pc") + 1).alias("pc"), "node", "loading").join(means.select("node"), "node", "left_semi"))
    side = load.groupBy("pc").agg(F.min_by("loading", F.struct(-F.round(F.abs("loading"), 12), "node")).alias("side"))
    load = load.join(F.broadcast(side), "pc").select("pc", "node", F.when(F.col("side") < 0, -F.col("loading")).otherwise(F.col("loading")).alias("loading"))
    return load, means, [float(a) / total for a in value[:kept]]
