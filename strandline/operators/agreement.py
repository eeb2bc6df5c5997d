"""Axes of one cohort held against those of another, and the table of features worth measuring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: added to norms, so that axes of zeros have no cosine rather than an error.
TINY = 1e-9


def projected_change(x: DataFrame, axis: DataFrame) -> DataFrame:
    """(patient_id, change) along axis (node, loading), of (patient_id, t, node, value) at t = 0 and 1; patients with one time only are left out.

    The sign of the time goes into the sum, so the two times needn't meet in a join.
    """
    sign = F.when(F.col("t") == 1, 1).otherwise(-1)
    d = x.where(F.col("t").isin(0, 1)).join(axis, "node")
    s = d.groupBy("patient_id").agg(F.sum(F.col("value") * F.col("loading") * sign).alias("change"), F.min("t").alias("__a"), F.max("t").alias("__b"))
    return s.where("__a = 0 AND __b = 1").select("patient_id", "change")


def _normed(axes: DataFrame) -> DataFrame:
    n = axes.groupBy("axis").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return axes.join(n, "axis")


def best_match(reference: DataFrame, candidates: DataFrame) -> DataFrame:
    """(axis, match, cosine): for each axis of (axis, node, value) the candidate of largest |cosine|, ties to the smaller; axes that share no node with any are left out."""
    a = _normed(reference).withColumnsRenamed({"value": "va", "norm": "na"})
    b = _normed(candidates).select("node", F.col("axis").alias("match"), F.col("value").alias("vb"), F.col("norm").alias("nb"))
    p = a.join(b, "node").groupBy("axis", "match").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    p = p.withColumn("cosine", F.abs("dot") / ((F.col("na") + TINY) * (F.col("nb") + TINY)))
    # sums in different orders differ in their last bits: ties are taken at nine digits
    best = F.min_by(F.struct("match", "cosine"), F.struct(-F.round("cosine", 9), F.col("match")))
    return p.groupBy("axis").agg(best.alias("m")).select("axis", "m.match", "m.cosine")


def _products(a: DataFrame, b: DataFrame, most: int) -> tuple[list, list, np.ndarray]:
    """All inner products of two sets of axes, ``most`` a set."""
    names = [sorted(r[0] for r in x.select("axis").distinct().limit(most + 1).collect()) for x in (a, b)]
    if max(map(len, names)) > most:
        raise ValueError(f"over {most} axes")
    p = a.join(b.select("node", F.col("axis").alias("other"), F.col("value").alias("vb")), "node").groupBy("axis", "other").agg(F.sum(F.col("value") * F.col("vb")).alias("dot"))
    out = np.zeros((len(names[0]), len(names[1])))
    for r in p.collect():
        out[names[0].index(r["axis"]), names[1].index(r["other"])] = r["dot"]
    return *names, out


def subspace_angles(a: DataFrame, b: DataFrame, most: int = 256) -> list[float]:
    """Principal angles in degrees, smallest first, between the spans of two sets of independent axes (axis, node, value).

    Nodes stay where they are: products of axes are aggregated, and only these (``most``
    squared at most) reach the driver, where they are whitened.
    """
    aa, bb, ab = (_products(x, y, most)[2] for x, y in ((a, a), (b, b), (a, b)))
    if not ab.size:
        return []
    mid = np.linalg.solve(np.linalg.cholesky(bb), np.linalg.solve(np.linalg.cholesky(aa), ab).T)
    return sorted(np.degrees(np.arccos(np.clip(np.linalg.svd(mid, compute_uv=False), -1, 1))).tolist())


def shared_top(loadings: DataFrame, a, b, k: int = 15, visible: DataFrame | None = None) -> DataFrame:
    """(node, weight, n_union) of the nodes among the k of largest |loading| on both axes of (axis, node, loading).

    weight is the sum of both |loading|, n_union the number of nodes on either list;
    ``visible`` (node) restricts what is returned, not what is counted.
    """
    top = [loadings.where(F.col("axis") == x).select("node", F.abs("loading").alias("w")).orderBy(F.desc(F.round("w", 9)), "node").limit(k) for x in (a, b)]
    both = top[0].unionByName(top[1]).groupBy("node").agg(F.sum("w").alias("weight"), F.count("*").alias("n"))
    out = both.crossJoin(both.agg(F.count("*").alias("n_union"))).where("n = 2").select("node", "weight", "n_union")  # one row
    return out if visible is None else out.join(visible.select("node"), "node", "left_semi")


def roi_table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with its header, and ``at``, the place of a row in its files."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True).withColumn("at", place)


def roi_by_anchor(table: DataFrame, modality: str | None = None) -> DataFrame:
    """One row an anchor_node, the last by ``at``; of one modality's rows if given."""
    if modality is not None:
        table = table.where(F.col("modality") == modality)
    rest = [c for c in table.columns if c not in ("anchor_node", "at")]
    return table.groupBy("anchor_node").agg(F.max_by(F.struct(*rest), "at").alias("r")).select("anchor_node", "r.*")
