"""Cox proportional hazards: all folds fitted in one pass over the rows, risk sets by suffix sums in two levels.

Rows (sample_id, fold, time, event, x) are dealt to ranges of time once. A round of Newton's
method takes the sums of each range for all models, adds up those of later ranges (a
window over the ranges, not over rows), and then every range's task has the risk sets of
its own events: likelihood, gradient and information of a range are added on the driver,
models x (1 + p + p^2) numbers each. Only these and the coefficients pass through it.

A time that many rows share has ranges of its own, split by a hash; all of its rows are in
the risk set of each, as ties are Breslow's. Features are scaled by the training rows of
each model, and ``penalty`` is a ridge on the scaled coefficients, as a share of the mean log
likelihood.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut
from .stats import c_index

#: Ranges of time.
RANGES = 128
ROUNDS = 40
#: The fold of the model of all rows.
WHOLE = -1


def dealt(sample_id: Column, folds: int) -> Column:
    """A fold for each sample, by a hash of its id."""
    return F.pmod(F.xxhash64(F.lit(11), sample_id), F.lit(folds)).cast("int")


def _ranged(d: DataFrame, ranges: int) -> DataFrame:
    """With ``span``, which grows with time, and ``part`` of it: over 0 only where one time fills several ranges."""
    marks = d.approxQuantile("time", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    edges, often = np.unique(np.array(marks, float), return_counts=True)

    @F.pandas_udf("long")
    def span(time: pd.Series) -> pd.Series:
        at = np.searchsorted(edges, time.to_numpy(), "left")
        hot = np.append(often, 0)[at] > 1
        same = np.append(edges, np.nan)[at] == time.to_numpy()
        return pd.Series(2 * at + (hot & same))

    many = {2 * i + 1: int(n) for i, n in enumerate(often) if n > 1}
    parts = F.lit(1)
    for s, n in many.items():  # as many as a third of all rows need, ``ranges`` / 2 at most
        parts = F.when(F.col("span") == s, n).otherwise(parts)
    d = d.withColumn("span", span("time"))
    return d.withColumn("part", F.pmod(F.xxhash64("sample_id"), parts.cast("long")))


def _scales(d: DataFrame, p: int) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Folds (with the whole last), and by model the number, means and standard deviations of its training rows."""
    cells = [F.count("*").alias("n")] + [f(i) for i in range(p) for f in (lambda i: F.sum(F.col("x")[i]).alias(f"s{i}"), lambda i: F.sum(F.col("x")[i] * F.col("x")[i]).alias(f"q{i}"))]
    got = sorted(d.groupBy("fold").agg(*cells).collect(), key=lambda r: r["fold"])  # a row a fold
    folds = [r["fold"] for r in got] + [WHOLE]
    own = np.array([[r["n"], *(r[f"s{i}"] for i in range(p)), *(r[f"q{i}"] for i in range(p))] for r in got], float)
    sums = np.vstack([own.sum(0) - own, own.sum(0)])
    n = np.maximum(sums[:, 0], 1)
    mean = sums[:, 1 : p + 1] / n[:, None]
    sd = np.sqrt(np.maximum(sums[:, p + 1 :] / n[:, None] - mean**2, 0))
    return folds, sums[:, 0], mean, np.where(sd > 1e-12, sd, 1.0)


class _Models:
    """What a task needs of the models: scaled features, weights in each."""

    def __init__(self, folds: list[int], mean: np.ndarray, sd: np.ndarray, beta: np.ndarray):
        self.folds, self.mean, self.sd, self.beta = np.array(folds), mean, sd, beta

    def each(self, pdf: pd.DataFrame):
        x, fold = np.array(pdf["x"].to_list(), float), pdf["fold"].to_numpy()
        for k, f in enumerate(self.folds):
            z = (x - self.mean[k]) / self.sd[k]
            eta = np.clip(z @ self.beta[k], -300, 300)
            yield z, eta, np.where(fold == f, 0.0, np.exp(eta)), fold != f

    def totals(self, pdf: pd.DataFrame) -> np.ndarray:
        """Sums of w, w x and w x x' over the rows, model after model."""
        return np.concatenate([np.concatenate([[w.sum()], w @ z, ((z * w[:, None]).T @ z).ravel()]) for z, _, w, _ in self.each(pdf)])

    def shares(self, pdf: pd.DataFrame, later: np.ndarray) -> np.ndarray:
        """Log likelihood, gradient and information of the events of a range; ``later`` are the totals of all rows of other ranges that are at risk."""
        pdf = pdf.sort_values("time", ascending=False, kind="stable")
        time, event = pdf["time"].to_numpy(), pdf["event"].to_numpy(bool)
        last = np.searchsorted(-time, -time, "right") - 1  # the last row of the same time
        first = np.searchsorted(-time, -time, "left")
        p, out = self.beta.shape[1], []
        size = 1 + p + p * p
        for k, (z, eta, w, train) in enumerate(self.each(pdf)):
            more = later[k * size : (k + 1) * size]
            s0 = np.cumsum(w)[last] + more[0]
            s1 = np.cumsum(z * w[:, None], axis=0)[last] + more[1 : p + 1]
            e = event & train
            one = np.where(e, 1 / np.where(e, s0, 1), 0.0)
            # the sum over events of their risk sets' second moments, row by row: each counts for the events up to its time
            upto = np.cumsum(one[::-1])[::-1][first]
            mean = s1[e] * one[e, None]
            second = (z * (w * upto)[:, None]).T @ z + more[p + 1 :].reshape(p, p) * one.sum()
            out.append(np.concatenate([[(eta[e] - np.log(s0[e])).sum()], (z[e] - mean).sum(0), (second - mean.T @ mean).ravel()]))
        return np.concatenate(out)


def _round(d: DataFrame, models: _Models) -> np.ndarray:
    """Log likelihood, gradient and information by model."""
    p, n = models.beta.shape[1], len(models.folds)

    def totals(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"span": [key[0]], "part": [key[1]], "s": [models.totals(pdf)]})

    def shares(key: tuple, pdf: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"s": [models.shares(pdf, np.array(later["s"].iloc[0], float))]})

    own = cut(d.groupBy("span", "part").applyInPandas(totals, "span long, part long, s array<double>"))
    at_risk = Window.partitionBy("i").orderBy(F.desc("span")).rangeBetween(Window.unboundedPreceding, 0)  # a row a range and number
    later = own.select("span", "part", F.posexplode("s").alias("i", "v")).withColumn("v", F.sum("v").over(at_risk) - F.col("v"))
    later = later.groupBy("span", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("s"))
    got = d.groupBy("span", "part").cogroup(later.groupBy("span", "part")).applyInPandas(shares, "s array<double>")
    total = np.zeros(n * (1 + p + p * p))
    for r in got.toLocalIterator():  # a row a range
        total += np.array(r["s"])
    return total.reshape(n, -1)


def fit(rows: DataFrame, penalty: float = 0.0, ranges: int = RANGES, tol: float = 1e-10) -> DataFrame:
    """(fold, feature, coef, mean, sd, rounds): of each fold's model, which is fitted without its rows, and of the model of all (fold -1).

    rows: (sample_id, fold, time, event, x array<double>); rows with a null in any, also within
    x, take no part. feature counts from 0; coef is per unit of the feature. Features that
    don't vary have coefficient 0. No rows, or none with an event, give none.
    """
    d = rows.select("sample_id", F.col("fold").cast("int").alias("fold"), F.col("time").cast("double").alias("time"), F.col("event").cast("boolean").alias("event"), F.col("x").cast("array<double>").alias("x"))
    d = d.dropna().where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)) & ~F.isnan("time"))
    head = d.agg(F.max(F.size("x")), F.count_if("event")).first()
    schema = "fold int, feature int, coef double, mean double, sd double, rounds int"
    if not head[0] or not head[1]:
        return rows.sparkSession.createDataFrame([], schema)
    p = head[0]
    d = cut(_ranged(d, ranges).repartition("span", "part"))
    folds, n, mean, sd = _scales(d, p)
    beta, step, best = np.zeros((len(folds), p)), np.zeros((len(folds), p)), np.full(len(folds), -np.inf)
    open_, taken = np.ones(len(folds), bool), np.zeros(len(folds), int)
    for _ in range(ROUNDS):
        got = _round(d, _Models(folds, mean, sd, beta))
        for k in np.flatnonzero(open_):
            like = got[k, 0] - 0.5 * penalty * n[k] * beta[k] @ beta[k]
            if like < best[k] - 1e-12 * abs(best[k]):  # too far: half of the way
                step[k] /= 2
                beta[k] -= step[k]
                open_[k] = np.abs(step[k]).max() > tol
                continue
            best[k], taken[k] = like, taken[k] + 1
            g = got[k, 1 : p + 1] - penalty * n[k] * beta[k]
            h = got[k, p + 1 :].reshape(p, p) + penalty * n[k] * np.eye(p)
            step[k] = np.linalg.lstsq(h, g, rcond=1e-12)[0]
            open_[k] = np.abs(step[k]).max() > tol
            beta[k] += step[k]
        if not open_.any():
            break
    out = [(int(f), i, float(beta[k, i] / sd[k, i]), float(mean[k, i]), float(sd[k, i]), int(taken[k])) for k, f in enumerate(folds) for i in range(p)]
    return rows.sparkSession.createDataFrame(out, schema)


def score_test(rows: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(feature, u, v, chi2) of all rows at coefficients of zero: gradient, information, and u^2 / v (the log-rank test, where x is a group)."""
    d = rows.select("sample_id", F.lit(0).alias("fold"), F.col("time").cast("double").alias("time"), F.col("event").cast("boolean").alias("event"), F.col("x").cast("array<double>").alias("x")).dropna()
    head = d.agg(F.max(F.size("x")), F.count_if("event")).first()
    if not head[0] or not head[1]:
        return rows.sparkSession.createDataFrame([], "feature int, u double, v double, chi2 double")
    p = head[0]
    got = _round(cut(_ranged(d, ranges)), _Models([WHOLE], np.zeros((1, p)), np.ones((1, p)), np.zeros((1, p))))[0]
    u, v = got[1 : p + 1], np.diag(got[p + 1 :].reshape(p, p))
    return rows.sparkSession.createDataFrame([(i, float(u[i]), float(v[i]), float(u[i] ** 2 / v[i]) if v[i] > 0 else None) for i in range(p)], "feature int, u double, v double, chi2 double")


def held_out_risks(rows: DataFrame, models: DataFrame) -> DataFrame:
    """(fold, sample_id, time, event, risk): each row by the model that didn't see it."""
    by = models.where(F.col("fold") != WHOLE).groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("feature", "coef", "mean"))).alias("m"))  # a row a fold
    risk = F.aggregate(F.zip_with("x", "m", lambda x, m: (x - m["mean"]) * m["coef"]), F.lit(0.0), lambda a, v: a + v)
    return rows.join(F.broadcast(by), "fold").select("fold", "sample_id", "time", "event", risk.alias("risk"))


def cross_validated(rows: DataFrame, penalty: float = 0.01, ranges: int = RANGES) -> DataFrame:
    """(fold, c_index, pairs): concordance of held-out risks with times."""
    return c_index(held_out_risks(rows, fit(rows, penalty, ranges)), ["fold"])
