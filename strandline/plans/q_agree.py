"""Queries: axes against axes, and features by their anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as ag
from ..operators import scoring as sc
from . import demo
from .catalogue import query

_E = "WITH e AS (SELECT vec_id, unnest(range(0, len(embedding))) AS node, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"


def _long(spark, sf):
    e = demo.read(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("node", "value"))
    return e.withColumn("value", F.col("value").cast("double"))


@query(_E + """
SELECT vec_id // 2 AS patient_id, round(sum(value * (node % 7 - 3) * CASE vec_id % 2 WHEN 1 THEN 1 ELSE -1 END), 6) AS change FROM e GROUP BY 1 HAVING count(DISTINCT vec_id % 2) = 2
""", demo=False)
def projected_change(spark, sf):
    e = _long(spark, sf)
    x = e.select(F.floor(F.col("vec_id") / 2).alias("patient_id"), (F.col("vec_id") % 2).alias("t"), "node", "value")
    return sc.rounded(ag.projected_change(x, e.select("node").distinct().withColumn("loading", F.col("node") % 7 - 3)))


@query(_E + """,
a AS (SELECT vec_id % 10 AS axis, node, sum(value) AS v FROM e GROUP BY 1, 2), b AS (SELECT vec_id // 10 % 10 AS axis, node, sum(value) AS v FROM e GROUP BY 1, 2),
na AS (SELECT axis, sqrt(sum(v * v)) AS n FROM a GROUP BY 1), nb AS (SELECT axis, sqrt(sum(v * v)) AS n FROM b GROUP BY 1),
d AS (SELECT a.axis, b.axis AS m, abs(sum(a.v * b.v)) AS dot FROM a JOIN b USING (node) GROUP BY 1, 2),
c AS (SELECT d.axis, m, dot / ((na.n + 1e-9) * (nb.n + 1e-9)) AS cosine FROM d JOIN na ON na.axis = d.axis JOIN nb ON nb.axis = m)
SELECT axis, m AS match, round(cosine, 6) AS cosine FROM c QUALIFY row_number() OVER (PARTITION BY axis ORDER BY round(cosine, 9) DESC, m) = 1
""", demo=False)
def best_match(spark, sf):
    e = _long(spark, sf)
    of = lambda key: e.groupBy(key.alias("axis"), "node").agg(F.sum("value").alias("value"))
    return sc.rounded(ag.best_match(of(F.col("vec_id") % 10), of(F.floor(F.col("vec_id") / 10) % 10)))


@query(_E + """,
l AS (SELECT vec_id % 2 AS axis, node, abs(sum(value)) AS w FROM e GROUP BY 1, 2),
t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY axis ORDER BY round(w, 9) DESC, node) <= 15)
SELECT node, round(sum(w), 6) AS weight, (SELECT count(DISTINCT node) FROM t) AS n_union FROM t GROUP BY node HAVING count(*) = 2
""", demo=False)
def shared_top_nodes(spark, sf):
    d = _long(spark, sf).groupBy((F.col("vec_id") % 2).alias("axis"), "node").agg(F.sum("value").alias("loading"))
    return sc.rounded(ag.shared_top(d, 0, 1))


@query("""
SELECT l_partkey AS anchor_node, arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS roi FROM lineitem GROUP BY 1
""", demo=False)
def roi_by_anchor(spark, sf):
    at = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return ag.roi_by_anchor(demo.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("anchor_node"), F.col("l_extendedprice").alias("roi"), at.alias("at")))
