"""Axes of patients by nodes: hub slope and residual, principal axes, alignment, fingerprints, pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lowrank


def beta_alpha(f: DataFrame, log_pr: DataFrame) -> DataFrame:
    """(patient_id, node, f, ...) with beta, the slope of the unit-length row on log_pr, and alpha, the centred residual. Rows of zeros are left out."""
    w = Window.partitionBy("patient_id")
    d = f.join(log_pr, "node").withColumn("__n", F.sqrt(F.sum(F.col("f") * F.col("f")).over(w))).where(F.col("__n") > 0).withColumn("x", F.col("f") / F.col("__n"))
    s = d.withColumns({"__mx": F.avg("x").over(w), "__mp": F.avg("log_pr").over(w)})
    dx, dp = F.col("x") - F.col("__mx"), F.col("log_pr") - F.col("__mp")
    s = s.withColumn("beta", F.sum(dx * dp).over(w) / F.sum(dp * dp).over(w))
    return s.withColumn("alpha", dx - F.col("beta") * dp).drop("__n", "__mx", "__mp")


def gram(x: DataFrame) -> DataFrame:
    """(a, b, dot) of the patients' column-centred rows: joined on nodes, so no patient is paired without shared nodes."""
    c = x.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("node")))
    a, b = c.select("node", F.col("patient_id").alias("a"), F.col("value").alias("va")), c.select("node", F.col("patient_id").alias("b"), F.col("value").alias("vb"))
    return a.join(b, "node").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))


def _axes(x: DataFrame, k: int) -> tuple[DataFrame, DataFrame, list[float], DataFrame]:
    """For ``models.loo_stability``: second moments by node x node where nodes are few (features), from executors' partial sums; eigenvectors on the driver.

    Each task adds up its patients' outer products, so what moves is one matrix per
    task; the width is checked, as the matrix must fit the driver.
    """
    width = x.agg(F.max("node")).first()[0]
    width = 0 if width is None else int(width) + 1
    if width > 4096:
        raise ValueError("over 4096 nodes: take the patients' Gram matrix (gram) or fewer nodes")
    rows = x.groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct("node", "value"))).alias("r"))

    def moments(batches):
        s, q, n = np.zeros(width), np.zeros((width, width)), 0
        for pdf in batches:
            if len(pdf):
                m = np.zeros((len(pdf), width))
                for i, r in enumerate(pdf["r"]):
                    for p in r:
                        m[i, int(p["node"])] = p["value"]
                s, q, n = s + m.sum(0), q + m.T @ m, n + len(pdf)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "q": [q.tobytes()]})

    n, s, q = 0, np.zeros(width), np.zeros((width, width))
    for r in rows.mapInPandas(moments, "n long, s binary, q binary").toLocalIterator():
        n, s, q = n + r["n"], s + np.frombuffer(r["s"]), q + np.frombuffer(r["q"]).reshape(width, width)
    mean = s / max(n, 1)
    cov = q / max(n, 1) - np.outer(mean, mean)
    value, vec = np.linalg.eigh(cov) if width else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-value)[: min(k, n, width)]
    vec = vec[:, order]
    sign = np.sign(vec[np.abs(vec).argmax(0), np.arange(vec.shape[1])]) if vec.size else np.zeros(0)
    vec = vec * sign  # the largest loading is positive
    spark = x.sparkSession
    load = spark.createDataFrame([(c + 1, i, float(vec[i, c])) for c in range(vec.shape[1]) for i in range(width)], "pc int, node int, loading double")
    means = spark.createDataFrame([(i, float(m)) for i, m in enumerate(mean)], "node int, mean double")
    total = float(np.maximum(value, 0).sum()) or 1.0
    return load, means, [float(value[i]) / total for i in order], rows


def pca_loadings(x: DataFrame, k: int) -> DataFrame:
    """(pc, node, loading); signs such that the largest loading is positive. Any number of nodes (``lowrank``)."""
    return lowrank.axes(x, k)[0]


def pca(x: DataFrame, k: int) -> DataFrame:
    """(patient_id, pc, score, explained) of (patient_id, node, value)."""
    load, means, share = lowrank.axes(x, k)
    ex = F.element_at(F.array(*map(F.lit, share or [0.0])), F.col("pc"))
    # what isn't there is zero: a mean's projection is taken from every patient's
    shift = load.join(means, "node").groupBy("pc").agg(F.sum(F.col("mean") * F.col("loading")).alias("shift"))
    d = x.withColumn("node", F.col("node").cast("int")).join(load, "node").groupBy("patient_id", "pc").agg(F.sum(F.col("value") * F.col("loading")).alias("score"))
    return d.join(F.broadcast(shift), "pc").select("patient_id", "pc", (F.col("score") - F.col("shift")).alias("score"), ex.alias("explained"))


def cosines(axes: DataFrame) -> DataFrame:
    """(a, b, cosine) with a < b: |cosine| of (axis, node, value) vectors."""
    n = axes.groupBy("axis").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"))
    d = axes.join(n, "axis")
    x, y = (d.select("node", F.col("axis").alias(k), F.col("value").alias(f"v{k}"), F.col("n").alias(f"n{k}")) for k in ("a", "b"))
    p = x.join(y, "node").where("a < b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("d"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return p.where("na > 0 AND nb > 0").select("a", "b", (F.abs("d") / (F.col("na") * F.col("nb"))).alias("cosine"))


def mass_by(alpha: DataFrame, key: str) -> DataFrame:
    """(patient_id, key, mass, signed): the key's share of the squared residual, and its sum."""
    t = alpha.groupBy("patient_id", key).agg(F.sum(F.col("alpha") * F.col("alpha")).alias("m"), F.sum("alpha").alias("signed"))
    return t.withColumn("mass", F.col("m") / F.sum("m").over(Window.partitionBy("patient_id"))).select("patient_id", key, "mass", "signed")


def peaks(alpha: DataFrame, k: int) -> DataFrame:
    """(node, peak, rank) of the k nodes of largest mean |alpha|."""
    p = alpha.groupBy("node").agg(F.avg(F.abs("alpha")).alias("peak"))
    top = p.orderBy(F.desc(F.round("peak", 9)), "node").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("peak", 9)), "node")))


def narrow_mass(loadings: DataFrame, ks: tuple[int, ...] = (10, 50, 100)) -> DataFrame:
    """(pc, top_k...) shares of squared loadings in the first k nodes."""
    w = Window.partitionBy("pc").orderBy(F.desc(F.abs("loading")), "node")
    d = loadings.withColumn("r", F.row_number().over(w)).withColumn("sq", F.col("loading") * F.col("loading"))
    return d.groupBy("pc").agg(*((F.sum(F.when(F.col("r") <= k, F.col("sq"))) / F.sum("sq")).alias(f"top_{k}") for k in ks))


def paired(x: DataFrame) -> DataFrame:
    """(patient_id, v0, v1, delta) from (patient_id, at, value): first and last of those with two or more."""
    p = x.groupBy("patient_id").agg(F.min_by("value", "at").alias("v0"), F.max_by("value", "at").alias("v1"), F.count("*").alias("n"))
    return p.where("n > 1").select("patient_id", "v0", "v1", (F.col("v1") - F.col("v0")).alias("delta"))


def mean_delta_angle(d: DataFrame, left: str, right: str) -> DataFrame:
    """One row (cosine, degrees) between the mean change of two groups: (grp, node, delta)."""
    m = d.where(F.col("grp").isin(left, right)).groupBy("node").agg(F.avg(F.when(F.col("grp") == left, F.col("delta"))).alias("a"), F.avg(F.when(F.col("grp") == right, F.col("delta"))).alias("b"))
    c = m.agg((F.sum(F.col("a") * F.col("b")) / F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b")))).alias("cosine"))
    return c.withColumn("degrees", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine")))))


def transitions(d: DataFrame, centroids: DataFrame) -> DataFrame:
    """(c0, c1, n): nearest centroid at both times of (patient_id, t, node, value), centroids (cluster, node, centre)."""
    dist = d.join(F.broadcast(centroids), "node").groupBy("patient_id", "t", "cluster").agg(F.sum((F.col("value") - F.col("centre")) * (F.col("value") - F.col("centre"))).alias("d2"))
    near = dist.groupBy("patient_id").pivot("t", [0, 1]).agg(F.min_by("cluster", F.struct(F.round("d2", 9), "cluster")))
    return near.groupBy(F.col("0").alias("c0"), F.col("1").alias("c1")).agg(F.count("*").alias("n"))


def top_variance(x: DataFrame, k: int) -> DataFrame:
    """Rows of the k features of largest variance (ties: id)."""
    v = x.groupBy("feature_id").agg(F.var_samp("value").alias("v")).where("v > 0")
    keep = v.orderBy(F.desc("v"), "feature_id").limit(k).select("feature_id")
    return x.join(F.broadcast(keep) if k <= 100_000 else keep, "feature_id", "left_semi")


