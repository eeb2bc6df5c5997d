"""Nearest neighbours by largest inner product: stable projections, kd-trees, a chi-square stopping test.

Largest inner product is nearest Euclidean neighbour after one more coordinate:
sqrt(M^2 - |x|^2) for rows, zero for queries, M the largest norm; a query is
stretched to norm M, which leaves its ranking as it is and sets near rows off best.
Rows are projected on ``DIMS`` Gaussian directions (2-stable: a squared projected
distance over the squared true one follows a chi-square law of ``DIMS`` degrees).

A kd-tree over projections of a bounded sample (``SAMPLE`` rows) cuts the projected
space into cells, ``CELLS`` at most; every row lies in one, and cells of over
``shard`` rows are dealt into shards, each with a kd-tree of its own. A query first
meets the cell in which it lies; the k-th distance d found there says which other
cells it must meet: those not farther (projected, squared) than the ``SURE`` quantile
of the chi-square law times d^2, since a row within d would, with that probability,
have shown a smaller projected distance (Sun et al., SRS, 2014). Inside a shard rows
come by growing projected distance under the same test, with d shrinking as they are
verified by true inner product. Rows meet queries in blocks of ``BLOCK`` of those that
come to their cell, so copies of rows follow from the queries that need them.

``effort`` says how many rows were verified. Where distances are as alike as in
isotropic noise (or norms as unlike as to drown angles), no cell is far enough to be
left out and the test works on rows alone.

Scores are inner products of the original vectors in double precision. Ties go
to the smaller vec_id; rows at exactly the stopping distance are still read, so
repeated vectors don't crowd each other out at random.

Defined results: vectors that are null, zero, of another length than most, or
hold null or non-finite components take no part (nor do null ids); repeated ids
are candidates each, but a query isn't its own candidate, and a repeated id asks once
(with the smallest of its vectors); fewer candidates than k give fewer rows; no rows
give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

DIMS = 24
SHARD = 8192
LEAF = 128
SURE = 0.95
#: Rows that the cells are fitted on, and cells, at most.
SAMPLE = 1 << 16
CELLS = 4096
#: Rows verified first; further steps double.
STEP = 128
#: Scores this much under the k-th are kept until the last, exact sum: faster sums differ in their last bits.
NEAR = 1e-9
#: Queries that meet a shard in one group.
BLOCK = 4096

#: Rows found; and for each query and shard one row without vec_id: the number of rows verified there.
FOUND = "query_id long, vec_id long, score double"


def chi_square_cdf(x: float, dims: int) -> float:
    """For an even number of degrees."""
    half, term, total = x / 2, 1.0, 1.0
    for j in range(1, dims // 2):
        term *= half / j
        total += term
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, dims) < p else (low, mid)
    return high


def directions(width: int, dims: int = DIMS, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


def inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with one vector, summed from the first component on: the same for equal rows, wherever they stand."""
    return np.cumsum(x * q, axis=1)[:, -1]


class Tree:
    """A kd-tree over projected points: halves at the median of the widest coordinate, down to leaves."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        todo, leaves = [np.arange(len(points))], []
        while todo:
            at = todo.pop()
            if len(at) <= leaf:
                leaves.append(at)
                continue
            p = points[at]
            axis = int(np.argmax(np.ptp(p, axis=0)))
            order = np.argpartition(p[:, axis], len(at) // 2)
            todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
        self.order = np.concatenate(leaves)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
        self.low = np.array([points[x].min(0) for x in leaves])
        self.high = np.array([points[x].max(0) for x in leaves])

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of a point to all boxes."""
        off = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return np.einsum("ij,ij->i", off, off)


class Cells:
    """Cuts of the projected space at medians of a sample; boxes are half open, so every point lies in one."""

    def __init__(self, points: np.ndarray, cells: int):
        dims = points.shape[1]
        # nodes by number: axis (-1: a cell), place of the cut, and children, or the cell
        self.nodes: list[list] = []
        low, high = [], []
        todo = [(np.arange(len(points)), cells, np.full(dims, -np.inf), np.full(dims, np.inf), None)]
        while todo:
            at, n, lo, hi, up = todo.pop()
            me = len(self.nodes)
            if up is not None:
                self.nodes[up[0]][up[1]] = me
            axis = int(np.argmax(np.ptp(points[at], axis=0))) if n > 1 and len(at) > 1 else -1
            cut = float(np.median(points[at, axis])) if axis >= 0 else 0.0
            under = points[at, axis] < cut
            if axis < 0 or not under.any():
                self.nodes.append([-1, 0.0, len(low), -1])
                low.append(lo)
                high.append(hi)
                continue
            self.nodes.append([axis, cut, -1, -1])
            left, right = hi.copy(), lo.copy()
            left[axis] = right[axis] = cut
            todo += [(at[under], n // 2, lo, left, (me, 2)), (at[~under], n - n // 2, right, hi, (me, 3))]
        self.low, self.high = np.array(low), np.array(high)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            axis, cut, left, right = self.nodes[node]
            if axis < 0:
                out[at] = left
            elif len(at):
                under = points[at, axis] < cut
                todo += [(left, at[under]), (right, at[~under])]
        return out

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of a point to all cells."""
        off = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return np.einsum("ij,ij->i", off, off)


def lifted(x: np.ndarray, top: float, way: np.ndarray) -> np.ndarray:
    """Projections of rows with their extra coordinate."""
    extra = np.sqrt(np.maximum(top * top - np.einsum("ij,ij->i", x, x), 0))
    return np.column_stack([x, extra]) @ way


def asked(q: np.ndarray, top: float, way: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors that stretch queries to the norm ``top``, and their projections."""
    stretch = top / np.sqrt(np.einsum("ij,ij->i", q, q))
    return stretch, (q * stretch[:, None]) @ way[:-1]


def within(kth: float, stretch: float, top: float, limit: float) -> float:
    """The squared projected distance at which to stop, given the k-th score."""
    return limit * max(2 * top * top - 2 * stretch * kth, 0.0) + 1e-9 * top * top


def search(
    ids: np.ndarray, x: np.ndarray, top: float, q_ids: np.ndarray, q: np.ndarray, k: int, sure: float = SURE, dims: int = DIMS, floor: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query, ids and scores of the k best rows found (best first, ties to smaller ids), and the number of rows verified.

    ``top``: largest norm anywhere; ``floor``: k-th scores known from elsewhere (else minus infinity).
    """
    way = directions(x.shape[1] + 1, dims)
    points = lifted(x, top, way)
    tree = Tree(points)
    ids, x, points = ids[tree.order], np.ascontiguousarray(x[tree.order]), points[tree.order]
    norms = np.einsum("ij,ij->i", points, points)
    limit = chi_square_quantile(sure, dims)
    stretch, projected = asked(q, top, way)
    place, first = np.arange(len(x)), tree.first.tolist()
    for n in range(len(q)):
        p = projected[n]
        away = tree.distances(p)
        leaves = np.argsort(away, kind="stable")
        near = away[leaves]
        kth = -math.inf if floor is None else float(floor[n])
        reach = math.inf if kth == -math.inf else within(kth, stretch[n], top, limit)
        kept_at, kept, verified = np.zeros(0, np.int64), np.zeros(0), 0
        at, step = 0, 4
        while at < len(leaves) and near[at] <= reach:
            end = min(at + step, int(np.searchsorted(near, reach, "right")))
            part = np.concatenate([place[first[i] : first[i + 1]] for i in leaves[at:end].tolist()])
            at, step = end, min(step * 2, 64)
            far = norms[part] - 2 * (points[part] @ p) + p @ p
            order = np.argsort(far, kind="stable")
            part, far = part[order], far[order]
            lo, some = 0, STEP
            while lo < len(part) and far[lo] <= reach:
                hi = min(lo + some, int(np.searchsorted(far, reach, "right")))
                rows = part[lo:hi]
                verified += hi - lo
                lo, some = hi, some * 2
                score = x[rows] @ q[n]
                good = (score >= kth - NEAR) & (ids[rows] != q_ids[n])
                kept_at, kept = np.concatenate([kept_at, rows[good]]), np.concatenate([kept, score[good]])
                if len(kept) >= k:
                    kth = max(kth, float(np.partition(kept, len(kept) - k)[len(kept) - k]))
                    good = kept >= kth - NEAR
                    kept_at, kept = kept_at[good], kept[good]
                    reach = within(kth, stretch[n], top, limit)
        best, best_ids = inner(x[kept_at], q[n]) if len(kept_at) else kept, ids[kept_at]
        order = np.lexsort((best_ids, -best))[:k]
        yield int(q_ids[n]), best_ids[order], best[order], verified


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the vectors that take part."""
    v = vectors.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    width = v.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).select("n").first()
    return v.where(F.size("v") == (width[0] if width else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def found(vectors: DataFrame, queries: DataFrame, k: int = 20, sure: float = SURE, shard: int = SHARD) -> DataFrame | None:
    """What ``FOUND`` says, from all cells; None without rows or queries."""
    row = vectors.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("m"), F.max(F.size("v")).alias("w")).first()
    n, top, width = row["n"], math.sqrt(row["m"] or 0.0) * (1 + 1e-12), row["w"]
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    if not n or queries.isEmpty():
        return None
    way, limit = directions(width + 1), chi_square_quantile(sure, DIMS)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def projected(v: pa.Array) -> pa.Array:
        return pa.array(list(lifted(_matrix(v), top, way)), pa.list_(pa.float64()))

    few = vectors if n <= SAMPLE else vectors.where(F.rand(7) < SAMPLE / n)
    # the draw has SAMPLE rows but for chance; the limit makes the bound certain
    sample = few.limit(2 * SAMPLE).select(projected("v").alias("p")).toArrow()["p"].combine_chunks()
    cells = Cells(_matrix(sample), max(1, min(CELLS, -(-n // shard))))

    @F.arrow_udf(T.IntegerType())
    def cell_of(v: pa.Array) -> pa.Array:
        return pa.array(cells.of(lifted(_matrix(v), top, way)), pa.int32())

    @F.arrow_udf(T.IntegerType())
    def home_of(v: pa.Array) -> pa.Array:
        return pa.array(cells.of(asked(_matrix(v), top, way)[1]), pa.int32())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def others(v: pa.Array, home: pa.Array, kth: pa.Array) -> pa.Array:
        """The cells that a query must meet besides its own."""
        stretch, p = asked(_matrix(v), top, way)
        out = []
        for a, b, h, s in zip(stretch, p, home.to_numpy(zero_copy_only=False), kth.to_pylist()):
            near = cells.distances(b) <= (math.inf if s is None else within(s, a, top, limit))
            near[h] = False
            out.append(np.flatnonzero(near).astype(np.int32))
        return pa.array(out, pa.list_(pa.int32()))

    v = cut(vectors.select("vec_id", "v", cell_of("v").alias("cell")))
    # CELLS rows at most
    parts = F.broadcast(v.groupBy("cell").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts")))
    v = v.join(parts, "cell").withColumn("part", F.floor(F.rand(5) * F.col("parts")).cast("int")).drop("parts")

    def meet(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros(0, np.int64)], [pd.array([], "Int64")], [np.zeros(0)]
        if len(rows) and len(asks):
            rows, asks = rows.sort_values("vec_id", kind="stable"), asks.sort_values("vec_id", kind="stable")
            x, q = np.vstack(rows["v"].to_numpy()), np.vstack(asks["v"].to_numpy())
            floor = asks["kth"].fillna(-math.inf).to_numpy(float)
            for i, got, score, verified in search(rows["vec_id"].to_numpy(), x, top, asks["vec_id"].to_numpy(), q, k, sure, floor=floor):
                for o, a in zip(out, (np.full(len(got) + 1, i), pd.array([*got.tolist(), None], "Int64"), np.append(score, float(verified)))):
                    o.append(a)
        return pd.DataFrame({"query_id": np.concatenate(out[0]), "vec_id": pd.concat([pd.Series(a) for a in out[1]], ignore_index=True), "score": np.concatenate(out[2])})

    def met(asks: DataFrame) -> DataFrame:
        """``asks``: vec_id, v, cell, kth."""
        load = F.broadcast(asks.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
        left = v.join(load, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = asks.join(load, "cell").join(parts, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        key = "cell", "part", "block"
        left, right = (d.select(*(F.col(c).alias(c) for c in names)) for d, names in ((left, (*key, "vec_id", "v")), (right, (*key, "vec_id", "v", "kth"))))
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, FOUND)

    q = cut(queries.select("vec_id", "v", home_of("v").alias("cell")))
    here = cut(met(q.withColumn("kth", F.lit(None).cast("double"))))
    best = _ranked(here, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("kth"))
    there = q.join(best, "vec_id", "left").select("vec_id", "v", "kth", F.explode(others("v", "cell", "kth")).alias("cell"))
    return here.unionByName(met(cut(there)))


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.where("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sure: float = SURE, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each of ``queries`` (both as ``usable`` gives them)."""
    rows = found(vectors, queries, k, sure, shard)
    if rows is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return _ranked(rows, k).select("query_id", "rank", "vec_id", "score")


def effort(vectors: DataFrame, queries: DataFrame, k: int = 20, sure: float = SURE, shard: int = SHARD) -> DataFrame:
    """query_id, verified: rows whose inner product was computed."""
    rows = found(vectors, queries, k, sure, shard)
    if rows is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, verified long")
    return rows.where("vec_id IS NULL").groupBy("query_id").agg(F.sum("score").cast("long").alias("verified"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = cut(usable(table(spark, sf_dir, "embeddings")))
    return nearest(v, v.where(F.col("vec_id") % 20 == 0))


#: Brute force in SQL, with the operator's order of summation: what recall is measured against.
EXACT = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), width AS (
  SELECT len(v) AS n FROM v GROUP BY len(v) ORDER BY count(*) DESC, n LIMIT 1
), fine AS (SELECT v.* FROM v JOIN width ON len(v.v) = width.n),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_reduce(list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] * q.v[i]), lambda a, b: a + b) AS score
  FROM (SELECT vec_id, min(v) AS v FROM fine WHERE vec_id % 20 = 0 GROUP BY vec_id) q JOIN fine c ON c.vec_id <> q.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
