"""Queries: survival of customers by what they are and order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring as sc
from ..operators import survival as sv
from . import demo
from .catalogue import query

#: Features are whole numbers, so that their sums are equal in any order.
CUSTOMERS = """
WITH c AS (SELECT c_custkey % 97 + 1 AS time, c_mktsegment <> 'BUILDING' AS event, CAST(floor(c_acctbal / 500) AS DOUBLE) AS x0, CASE WHEN c_nationkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS x1, CAST(coalesce(n, 0) AS DOUBLE) AS x2
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)
"""


def customers(spark, sf):
    c = demo.read(spark, sf, "customer")
    n = demo.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    x = F.array(F.floor(F.col("c_acctbal") / 500).cast("double"), (F.col("c_nationkey") % 3 == 0).cast("double"), F.coalesce("n", F.lit(0)).cast("double"))
    d = c.join(n, "c_custkey", "left")
    return d.select(F.col("c_custkey").alias("sample_id"), sv.dealt(F.col("c_custkey"), 5).alias("fold"), (F.col("c_custkey") % 97 + 1).cast("double").alias("time"), (F.col("c_mktsegment") != "BUILDING").alias("event"), x.alias("x"))


@query(CUSTOMERS + """,
f AS (SELECT time, event, unnest([0, 1, 2]) AS feature, unnest([x0, x1, x2]) AS x FROM c),
t AS (SELECT feature, time, count(*) AS n, sum(x) AS s1, sum(x * x) AS s2, count(*) FILTER (WHERE event) AS d, coalesce(sum(x) FILTER (WHERE event), 0) AS e FROM f GROUP BY 1, 2),
r AS (SELECT feature, d, e, sum(n) OVER w AS s0, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2 FROM t WINDOW w AS (PARTITION BY feature ORDER BY time DESC)),
g AS (SELECT feature, sum(e - d * s1 / s0) AS u, sum(d * (s2 / s0 - (s1 / s0) * (s1 / s0))) AS v FROM r GROUP BY 1)
SELECT CAST(feature AS INTEGER) AS feature, round(u, 6) AS u, round(v, 6) AS v, round(u * u / v, 6) AS chi2 FROM g
""", demo=False)
def cox_score_test(spark, sf):
    return sc.rounded(sv.score_test(customers(spark, sf)))


@query()
def cox_folds(spark, sf):
    return sc.rounded(sv.fit(customers(spark, sf), 0.01))


@query()
def cox_concordance(spark, sf):
    return sc.rounded(sv.cross_validated(customers(spark, sf), 0.01))
