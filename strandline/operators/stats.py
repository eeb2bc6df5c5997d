"""Statistics as aggregates and windows: ranks, tests, adjustments, z-scores, references."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special as sp


def bh(df: DataFrame, p: str = "p_value", q: str = "fdr", within: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg: min over larger p of p x n / rank, one at most. Null p stay null and don't count.

    Ranks run over each test family (``within``), which is as large as there are
    sets or features; a family of all rows is one window.
    """
    keys = [F.col(k) for k in within or []]
    fam = Window.partitionBy(*keys, F.col(p).isNull())
    up = fam.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("__n", F.count(p).over(fam)).withColumn("__r", F.count("*").over(fam.orderBy(p).rangeBetween(Window.unboundedPreceding, 0)))
    raw = F.col(p) * F.col("__n") / F.col("__r")
    return d.withColumn("__raw", raw).withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__raw").over(up)))).drop("__n", "__r", "__raw")


def average_rank(value: str, keys: list[str]) -> Column:
    """Ranks from 1 within keys, ties at their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def auc(df: DataFrame, keys: list[str], value: str, label: str) -> DataFrame:
    """keys, n_pos, n_neg, auc, u: from average ranks (label is boolean; nulls of either are left out)."""
    d = df.where(F.col(value).isNotNull() & F.col(label).isNotNull()).withColumn("__r", average_rank(value, keys))
    a = d.groupBy(*keys).agg(F.count_if(F.col(label)).alias("n_pos"), F.count_if(~F.col(label)).alias("n_neg"), F.sum(F.when(F.col(label), F.col("__r"))).alias("rs"))
    u = F.col("rs") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    return a.where("n_pos > 0 AND n_neg > 0").select(*keys, "n_pos", "n_neg", (u / (F.col("n_pos") * F.col("n_neg"))).alias("auc"), u.alias("u"))


def mann_whitney(df: DataFrame, keys: list[str], value: str, label: str) -> DataFrame:
    """AUC with z and two-sided p: normal approximation, corrected for ties and continuity."""
    base = auc(df, keys, value, label)
    d = df.where(F.col(value).isNotNull() & F.col(label).isNotNull())
    ties = d.groupBy(*keys, value).agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    n = F.col("n_pos") + F.col("n_neg")
    var = F.col("n_pos") * F.col("n_neg") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    off = F.greatest(F.abs(F.col("u") - F.col("n_pos") * F.col("n_neg") / 2) - 0.5, F.lit(0.0))
    out = base.join(ties, keys).withColumn("z", F.when(var > 0, off / F.sqrt(var)).otherwise(0.0)).drop("ties")
    return out.withColumn("p_value", F.least(F.lit(1.0), 2 * sp.normal_sf_col(F.col("z"))))


def kruskal(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """keys, h (tie-corrected), groups, p_value."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).withColumn("__r", average_rank(value, keys))
    per = d.groupBy(*keys, group).agg(F.sum("__r").alias("s"), F.count("*").alias("n"))
    h = per.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum("n").alias("n"), F.count("*").alias("groups"))
    ties = d.groupBy(*keys, value).agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    n = F.col("n")
    raw = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    out = h.join(ties, keys).withColumn("fix", 1 - F.col("ties") / (n * n * n - n)).where("groups > 1")
    out = out.select(*keys, "groups", F.when(F.col("fix") > 0, raw / F.col("fix")).otherwise(0.0).alias("h"))
    return out.withColumn("p_value", sp.chi2_sf_col(F.col("h"), (F.col("groups") - 1).cast("double")))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, rho, p_value (t approximation)."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"__x": average_rank(x, keys), "__y": average_rank(y, keys)})
    out = d.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("__x", "__y").alias("rho"))
    t = F.col("rho") * F.sqrt((F.col("n") - 2) / F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(1e-300)))
    return out.withColumn("p_value", F.when(F.col("n") > 2, sp.t_sf2_col(t, (F.col("n") - 2).cast("double"))))


def strength(df: DataFrame, keys: list[str], axis: str, meta: str, binary: bool) -> DataFrame:
    """2 |AUC - 1/2| for a boolean, |rho| for a number."""
    if binary:
        return auc(df, keys, axis, meta).select(*keys, (2 * F.abs(F.col("auc") - 0.5)).alias("strength"))
    return spearman(df, keys, axis, meta).select(*keys, F.abs("rho").alias("strength"))


def within_patient_z(df: DataFrame, log: bool = False, least: int = 10) -> DataFrame:
    """(sample_id, feature_id, value) to z: positive values only, population deviation + 1e-9, samples of ``least`` such values or more."""
    w = Window.partitionBy("sample_id")
    d = df.where("value > 0").withColumn("value", F.log1p("value") if log else F.col("value"))
    z = (F.col("value") - F.avg("value").over(w)) / (F.stddev_pop("value").over(w) + 1e-9)
    return d.withColumns({"z": z, "__n": F.count("*").over(w)}).where(F.col("__n") >= least).drop("__n")


def per_feature_z(df: DataFrame, log: bool = True) -> DataFrame:
    """z over each feature's samples; values are logged unless any of the table is negative."""
    w = Window.partitionBy("feature_id")
    if log:
        neg = df.agg(F.bool_or(F.col("value") < 0).alias("neg"))
        df = df.crossJoin(neg).withColumn("value", F.when(F.coalesce("neg", F.lit(False)), F.col("value")).otherwise(F.log1p("value"))).drop("neg")  # one row
    return df.withColumn("z", (F.col("value") - F.avg("value").over(w)) / (F.stddev_pop("value").over(w) + 1e-9))


def references(df: DataFrame, how: str = "mean", least_controls: int = 3) -> DataFrame:
    """(sample_id, feature_id, value[, control]) to feature_id, reference.

    mean of the cohort; mean of the controls where there are ``least_controls``, else of
    the cohort; or the upper median (the sorted values' element n // 2).
    """
    if how == "mean":
        r = F.avg("value")
    elif how == "control":
        r = F.when(F.count_if(F.col("control")) >= least_controls, F.avg(F.when(F.col("control"), F.col("value")))).otherwise(F.avg("value"))
    else:
        # the order statistic after the middle; percentile_disc needs no list of a feature's values
        return upper_median(df)
    return df.groupBy("feature_id").agg(r.alias("reference"))


def upper_median(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("feature_id")
    d = df.withColumns({"__r": F.row_number().over(w.orderBy("value")), "__n": F.count("*").over(w)})
    return d.where(F.col("__r") == F.floor(F.col("__n") / 2) + 1).select("feature_id", F.col("value").alias("reference"))


def effects(df: DataFrame, refs: DataFrame) -> DataFrame:
    """sample_id, feature_id, effect = value - reference."""
    return df.join(refs, "feature_id").select("sample_id", "feature_id", (F.col("value") - F.col("reference")).alias("effect"))


def feature_roi(df: DataFrame, loadings: DataFrame, cost: DataFrame) -> DataFrame:
    """feature_id, roi = |loading| x population deviation / cost; features that don't vary are left out."""
    sd = df.groupBy("feature_id").agg(F.stddev_pop("value").alias("sd")).where("sd > 0")
    return sd.join(loadings, "feature_id").join(cost, "feature_id").select("feature_id", (F.abs("loading") * F.col("sd") / F.col("cost")).alias("roi"))


#: Fixed value: the prior's degrees of freedom where variances differ no more than by chance.
MOST_FREEDOM = 1e6


def moderated_t(df: DataFrame, least: int = 2) -> DataFrame:
    """(feature_id, value, is_case) to effect, t, df, p_value with an empirical Bayes prior of variances (Smyth, 2004).

    One shuffle gives counts, means and variances; the prior needs three sums over
    features. Under three features of positive variance the plain t is given, of those alone.
    """
    case = F.col("is_case")
    fine = df.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    v = lambda c: F.when(c, F.col("value"))
    s = fine.groupBy("feature_id").agg(
        F.count(v(case)).alias("n1"), F.count(v(~case)).alias("n0"), F.avg(v(case)).alias("m1"), F.avg(v(~case)).alias("m0"),
        F.coalesce(F.var_samp(v(case)), F.lit(0.0)).alias("v1"), F.coalesce(F.var_samp(v(~case)), F.lit(0.0)).alias("v0"),
    ).where((F.col("n1") >= least) & (F.col("n0") >= least))
    s = s.withColumn("d", (F.col("n1") + F.col("n0") - 2).cast("double")).withColumn("s2", ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / F.col("d"))
    pos = s.where("s2 > 0").select((F.log("s2") - sp.digamma_col(F.col("d") / 2) + F.log(F.col("d") / 2)).alias("e"), F.log("s2").alias("l"), sp.trigamma_col(F.col("d") / 2).alias("tri"))
    row = pos.agg(F.count("*").alias("n"), F.avg("e").alias("m"), F.var_samp("l").alias("v"), F.avg("tri").alias("tri")).first()
    if row["n"] < 3:
        d0, s0, s = 0.0, 0.0, s.where("s2 > 0")
    else:
        # the prior variance is exp(mean of ln s2 less its correction for the features' own freedom), and none for the prior's
        extra = row["v"] - row["tri"]
        d0, s0 = (2 * sp.inverse_trigamma(extra) if extra > 0 else MOST_FREEDOM), math.exp(row["m"])
    s2, dof = (d0 * s0 + F.col("d") * F.col("s2")) / (d0 + F.col("d")), F.col("d") + d0
    t = (F.col("m1") - F.col("m0")) / F.sqrt(s2 * (1 / F.col("n1") + 1 / F.col("n0")))
    out = s.withColumns({"effect": F.col("m1") - F.col("m0"), "t": t, "df": dof})
    return out.withColumn("p_value", sp.t_sf2_col(F.col("t"), F.col("df"))).select("feature_id", "n1", "n0", "effect", "t", "df", "p_value")


def c_index(df: DataFrame, keys: list[str]) -> DataFrame:
    """Harrell's C of (time, event, risk) by key: of pairs whose earlier time is an event, the share of higher risk (ties half).

    A group is sorted and counted in n log n; a group is one cohort.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema) + ", c_index double, pairs long"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf.sort_values("time", ascending=False, kind="stable")
        risk = np.searchsorted(np.unique(d["risk"]), d["risk"]) + 1
        tree, size, seen, good, pairs = np.zeros(risk.max() + 1, np.int64), int(risk.max()), 0, 0.0, 0

        def below(i: int) -> int:
            n = 0
            while i > 0:
                n += tree[i]
                i -= i & -i
            return int(n)

        t, e = d["time"].to_numpy(), d["event"].to_numpy(bool)
        i = 0
        while i < len(d):
            j = i
            while j < len(d) and t[j] == t[i]:
                j += 1
            for k in range(i, j):
                if e[k]:
                    low, upto = below(int(risk[k]) - 1), below(int(risk[k]))
                    good += low + (upto - low) / 2
                    pairs += seen
            for k in range(i, j):
                r = int(risk[k])
                while r <= size:
                    tree[r] += 1
                    r += r & -r
            seen += j - i
            i = j
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), good / pairs if pairs else math.nan, pairs]], columns=[*keys, "c_index", "pairs"])

    return df.dropna(subset=["time", "event", "risk"]).groupBy(*keys).applyInPandas(one, schema)


def empirical_p(observed: Column, null: Column, tail: str = "greater") -> Column:
    """An aggregate: (1 + nulls as extreme) / (1 + nulls)."""
    hit = {"greater": null >= observed, "less": null <= observed, "two-sided": F.abs(null) >= F.abs(observed)}[tail]
    return (F.count_if(hit) + 1) / (F.count(null) + 1)


def stouffer(ps: list[float], weights: list[float] | None = None) -> float:
    w = weights or [1.0] * len(ps)
    z = [sp.normal_isf(min(max(p, 1e-300), 1 - 1e-16)) for p in ps]
    return float(sp.normal_sf(np.array([sum(a * b for a, b in zip(w, z)) / math.sqrt(sum(a * a for a in w))]))[0])
