"""Queries: statistics over the demo graph's scores and measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as sc
from ..operators import stats as st
from ..operators.iterate import portions
from . import demo
from .catalogue import query

#: One value for a customer and part: the mean price of a line in whole cents, so that sums are exact in any order.
MEASURE = """
measure AS (
  SELECT o_custkey AS sample_id, l_partkey AS feature_id, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) // count(*) AS DOUBLE) AS value
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2
), cases AS (SELECT c_custkey AS sample_id, c_mktsegment = 'BUILDING' AS is_case, c_nationkey AS cohort FROM customer),
lab AS (SELECT * FROM measure JOIN cases USING (sample_id))
"""


def parts(spark, sf) -> int:
    """Into how many parts measurements are dealt."""
    return portions(spark, demo.read(spark, sf, "lineitem").count())


def measure(spark, sf, *deal: str):
    """``deal``: columns by which rows are dealt before they are summed, for what follows on those."""
    n = parts(spark, sf)
    li = demo.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order"), F.col("l_partkey").alias("feature_id"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")).repartition(n, "order")
    o = demo.read(spark, sf, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("sample_id")).repartition(n, "order")
    m = li.join(o, "order").select("sample_id", "feature_id", "cents").repartition(n, *(deal or ("sample_id", "feature_id")))
    return m.groupBy("sample_id", "feature_id").agg(F.floor(F.sum("cents") / F.count("*")).cast("double").alias("value"))


def cases(spark, sf):
    return demo.read(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), (F.col("c_mktsegment") == "BUILDING").alias("is_case"), F.col("c_nationkey").alias("cohort"))


def labelled(spark, sf):
    """Dealt by feature."""
    return measure(spark, sf, "sample_id").join(cases(spark, sf), "sample_id").repartition(parts(spark, sf), "feature_id")


def _q(sql):
    return query(f"WITH {MEASURE.strip()}{sql}", demo=False)


@_q("""
, z AS (SELECT sample_id, feature_id, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-9) AS z, count(*) OVER w AS n FROM measure WHERE value > 0 WINDOW w AS (PARTITION BY sample_id))
SELECT sample_id, feature_id, round(z, 6) AS z FROM z WHERE n >= 10
""")
def within_patient_z(spark, sf):
    return sc.rounded(st.within_patient_z(measure(spark, sf, "sample_id")).select("sample_id", "feature_id", "z"))


@_q("""
SELECT sample_id, feature_id, round((ln(1 + value) - avg(ln(1 + value)) OVER w) / (stddev_pop(ln(1 + value)) OVER w + 1e-9), 6) AS z FROM measure WINDOW w AS (PARTITION BY feature_id)
""")
def per_feature_z(spark, sf):
    return sc.rounded(st.per_feature_z(measure(spark, sf, "feature_id")).select("sample_id", "feature_id", "z"))


@_q("""
, r AS (SELECT feature_id, value, row_number() OVER (PARTITION BY feature_id ORDER BY value) AS r, count(*) OVER (PARTITION BY feature_id) AS n FROM measure)
SELECT m.feature_id, round(m.mean_reference, 6) AS mean_reference, round(m.control_reference, 6) AS control_reference, round(r.value, 6) AS upper_median
FROM (SELECT feature_id, avg(value) AS mean_reference, CASE WHEN count(*) FILTER (WHERE NOT is_case) >= 3 THEN avg(value) FILTER (WHERE NOT is_case) ELSE avg(value) END AS control_reference FROM lab GROUP BY 1) m
JOIN r ON r.feature_id = m.feature_id AND r.r = r.n // 2 + 1
""")
def sample_references(spark, sf):
    d = labelled(spark, sf).withColumn("control", ~F.col("is_case"))
    out = st.references(d, "mean").withColumnRenamed("reference", "mean_reference")
    out = out.join(st.references(d, "control").withColumnRenamed("reference", "control_reference"), "feature_id")
    return sc.rounded(out.join(st.references(d, "upper_median").withColumnRenamed("reference", "upper_median"), "feature_id"))


@_q("""
SELECT sample_id, feature_id, round(value - avg(value) OVER (PARTITION BY feature_id), 6) AS effect FROM measure
""")
def sample_effects(spark, sf):
    m = measure(spark, sf, "feature_id")
    return sc.rounded(st.effects(m, st.references(m)))


@_q("""
, r AS (SELECT *, rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0 AS r FROM lab),
a AS (SELECT feature_id, count(*) FILTER (WHERE is_case) AS n_pos, count(*) FILTER (WHERE NOT is_case) AS n_neg, sum(r) FILTER (WHERE is_case) AS rs FROM r GROUP BY 1)
SELECT feature_id, n_pos, n_neg, round((rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 6) AS auc, CAST(rs - n_pos * (n_pos + 1) / 2.0 AS DOUBLE) AS u FROM a WHERE n_pos > 0 AND n_neg > 0
""")
def feature_auc(spark, sf):
    return sc.rounded(st.auc(labelled(spark, sf), ["feature_id"], "value", "is_case"))


@_q("""
, r AS (SELECT *, rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0 AS r FROM lab),
t AS (SELECT feature_id, sum(n * n * n - n) AS ties FROM (SELECT feature_id, value, count(*) AS n FROM lab GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT feature_id, count(*) FILTER (WHERE is_case) AS p, count(*) FILTER (WHERE NOT is_case) AS q, sum(r) FILTER (WHERE is_case) AS rs FROM r GROUP BY 1),
v AS (SELECT feature_id, greatest(abs(rs - p * (p + 1) / 2.0 - p * q / 2.0) - 0.5, 0.0) AS off, p * q / 12.0 * ((p + q + 1) - ties / ((p + q) * (p + q - 1))) AS var FROM a JOIN t USING (feature_id) WHERE p > 0 AND q > 0)
SELECT feature_id, round(CASE WHEN var > 0 THEN off / sqrt(var) ELSE 0.0 END, 6) AS z FROM v
""")
def mann_whitney(spark, sf):
    return sc.rounded(st.mann_whitney(labelled(spark, sf), ["feature_id"], "value", "is_case").select("feature_id", "z"))


@_q("""
, r AS (SELECT feature_id, cohort, rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0 AS r FROM lab),
g AS (SELECT feature_id, cohort, sum(r) AS s, count(*) AS n FROM r GROUP BY 1, 2),
h AS (SELECT feature_id, sum(s * s / n) AS q, CAST(sum(n) AS DOUBLE) AS n, count(*) AS groups FROM g GROUP BY 1),
t AS (SELECT feature_id, CAST(sum(n * n * n - n) AS DOUBLE) AS ties FROM (SELECT feature_id, value, count(*) AS n FROM lab GROUP BY 1, 2) GROUP BY 1)
SELECT feature_id, groups, round(CASE WHEN 1 - ties / (n * n * n - n) > 0 THEN (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) ELSE 0.0 END, 6) AS h FROM h JOIN t USING (feature_id) WHERE groups > 1
""")
def kruskal_wallis(spark, sf):
    return sc.rounded(st.kruskal(labelled(spark, sf), ["feature_id"], "value", "cohort").select("feature_id", "groups", "h"))


@_q("""
, d AS (SELECT m.sample_id, m.feature_id, m.value AS x, c.c_acctbal AS y FROM measure m JOIN customer c ON c.c_custkey = m.sample_id),
r AS (SELECT feature_id, rank() OVER (PARTITION BY feature_id ORDER BY x) + (count(*) OVER (PARTITION BY feature_id, x) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY feature_id ORDER BY y) + (count(*) OVER (PARTITION BY feature_id, y) - 1) / 2.0 AS b FROM d)
SELECT feature_id, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY feature_id HAVING count(*) > 2
""")
def spearman(spark, sf):
    c = demo.read(spark, sf, "customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_acctbal").alias("y"))
    d = measure(spark, sf, "sample_id").join(c, "sample_id").repartition(parts(spark, sf), "feature_id")
    s = st.spearman(d, ["feature_id"], "value", "y")
    return sc.rounded(s.where("n > 2").select("feature_id", "n", "rho"))


@_q("""
, sd AS (SELECT feature_id, stddev_pop(value) AS sd FROM measure GROUP BY 1 HAVING stddev_pop(value) > 0)
SELECT feature_id, round((p_size / 50.0) * sd / p_retailprice, 6) AS roi FROM sd JOIN part ON p_partkey = feature_id
""")
def feature_roi(spark, sf):
    p = demo.read(spark, sf, "part")
    load, cost = p.select(F.col("p_partkey").alias("feature_id"), (F.col("p_size") / -50.0).alias("loading")), p.select(F.col("p_partkey").alias("feature_id"), F.col("p_retailprice").alias("cost"))
    return sc.rounded(st.feature_roi(measure(spark, sf, "feature_id"), load, cost))


@_q("""
, s AS (SELECT feature_id, count(*) FILTER (WHERE is_case) AS n1, count(*) FILTER (WHERE NOT is_case) AS n0, avg(value) FILTER (WHERE is_case) - avg(value) FILTER (WHERE NOT is_case) AS effect FROM lab GROUP BY 1)
SELECT feature_id, n1, n0, round(effect, 6) AS effect FROM s WHERE n1 >= 2 AND n0 >= 2
""")
def moderated_t(spark, sf):
    return sc.rounded(st.moderated_t(labelled(spark, sf)).select("feature_id", "n1", "n0", "effect"))


@query(None)
def moderated_t_p(spark, sf):
    return st.bh(st.moderated_t(labelled(spark, sf)))


@query("""
WITH d AS (SELECT c_nationkey AS cohort, c_custkey % 97 AS time, c_mktsegment <> 'BUILDING' AS event, round(c_acctbal / 500) AS risk FROM customer)
SELECT a.cohort, count(*) AS pairs, round(avg(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END), 6) AS c_index FROM d a JOIN d b ON a.cohort = b.cohort AND a.time < b.time AND a.event GROUP BY a.cohort
""", demo=False)
def concordance(spark, sf):
    c = demo.read(spark, sf, "customer")
    d = c.select(F.col("c_nationkey").alias("cohort"), (F.col("c_custkey") % 97).alias("time"), (F.col("c_mktsegment") != "BUILDING").alias("event"), F.round(F.col("c_acctbal") / 500).alias("risk"))
    return sc.rounded(st.c_index(d, ["cohort"]).where("pairs > 0"))


@query("""
WITH p AS (SELECT p_partkey AS test_id, (p_partkey * 7919 % 1000 + 1) / 1001.0 AS p_value FROM part),
r AS (SELECT *, count(*) OVER (ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r, count(*) OVER () AS n FROM p)
SELECT test_id, round(least(1.0, min(p_value * n / r) OVER (ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS fdr FROM r
""", demo=False)
def bh_fdr(spark, sf):
    p = demo.read(spark, sf, "part").select(F.col("p_partkey").alias("test_id"), ((F.col("p_partkey") * 7919 % 1000 + 1) / 1001.0).alias("p_value"))
    return sc.rounded(st.bh(p).select("test_id", "fdr"))


@query("""
WITH n AS (SELECT l_suppkey AS draw, l_discount AS x FROM lineitem), o AS (SELECT s_suppkey AS draw, s_acctbal / 100000.0 AS obs FROM supplier)
SELECT draw, round((1 + count(*) FILTER (WHERE x >= obs)) / (1.0 + count(*)), 6) AS p_value FROM n JOIN o USING (draw) GROUP BY draw
""", demo=False)
def empirical_p(spark, sf):
    n = demo.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("draw"), F.col("l_discount").alias("x"))
    o = demo.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("draw"), (F.col("s_acctbal") / 100000.0).alias("obs"))
    return sc.rounded(n.join(o, "draw").groupBy("draw").agg(st.empirical_p(F.col("obs"), F.col("x")).alias("p_value")))
