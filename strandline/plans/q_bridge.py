"""Queries: cells, trees and seeds over metabolites and reactions of the demo graph.

Terminals are the parts of every tenth size, a set for each brand; seeds are chosen
from effects of metabolites by sign.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bridging as br
from ..operators import iterate as it
from ..operators import scoring as sc
from . import demo
from .catalogue import query

#: Rounds that the SQL is unrolled to: no node of the driver's tables is farther from a terminal.
ROUNDS = 12


def _ground(spark, sf):
    g = demo.graph(spark, sf)
    return it.restricted(g, ["metabolite", "reaction"])


def _terminals(spark, sf):
    p = demo.read(spark, sf, "part")
    return p.where("p_size % 10 = 3").select(F.col("p_brand").alias("set"), F.concat(F.lit("met:"), "p_partkey").alias("node_id"))


def _cells_sql() -> str:
    sql = """
, pair AS MATERIALIZED (SELECT DISTINCT b.node_id, b.other FROM both_ways b JOIN nodes x ON x.node_id = b.node_id AND x.node_type IN ('metabolite', 'reaction') AND NOT x.is_currency
  JOIN nodes y ON y.node_id = b.other AND y.node_type IN ('metabolite', 'reaction') AND NOT y.is_currency),
c0 AS MATERIALIZED (SELECT p_brand AS s, 'met:' || p_partkey AS node_id, 'met:' || p_partkey AS owner, 0 AS hops FROM part WHERE p_size % 10 = 3)"""
    for i in range(1, ROUNDS + 1):
        sql += f""",
c{i} AS MATERIALIZED (SELECT * FROM c{i - 1} UNION ALL SELECT c.s, p.other, min(c.owner), {i} FROM c{i - 1} c JOIN pair p ON p.node_id = c.node_id
  WHERE c.hops = {i - 1} AND NOT EXISTS (SELECT 1 FROM c{i - 1} k WHERE k.s = c.s AND k.node_id = p.other) GROUP BY c.s, p.other)"""
    return sql


@query(_cells_sql() + f'SELECT s AS "set", node_id, owner, hops FROM c{ROUNDS}')
def distance_cells(spark, sf):
    return br.distance_cells(br.undirected(_ground(spark, sf)), _terminals(spark, sf), parents=False)


# the weight of a minimum spanning forest is, over all thresholds, the sum of parts that still wait to be linked
@query(_cells_sql() + f""",
x AS MATERIALIZED (SELECT c.s, c.owner AS a, d.owner AS b, min(c.hops + d.hops + 1) AS weight FROM c{ROUNDS} c JOIN pair p ON p.node_id = c.node_id JOIN c{ROUNDS} d ON d.s = c.s AND d.node_id = p.other WHERE c.owner <> d.owner GROUP BY 1, 2, 3),
w AS (SELECT range AS w FROM range((SELECT coalesce(max(weight), 0) + 1 FROM x))),
near AS (SELECT s, w, node_id AS a, node_id AS b FROM c0, w UNION SELECT n.s, n.w, n.a, x.b FROM near n JOIN x ON x.s = n.s AND x.a = n.b AND x.weight <= n.w),
label AS (SELECT s, w, a, min(b) AS part FROM near GROUP BY 1, 2, 3),
parts AS (SELECT s, w, count(DISTINCT part) AS n FROM label GROUP BY 1, 2),
last AS (SELECT s, min(n) AS n FROM parts GROUP BY 1)
SELECT s AS "set", (SELECT count(*) FROM c0 WHERE c0.s = parts.s) AS n_terminals, any_value(last.n) AS n_trees, CAST(sum(parts.n - last.n) AS BIGINT) AS weight FROM parts JOIN last USING (s) GROUP BY s
""")
def spanning_weights(spark, sf):
    pairs, t = br.undirected(_ground(spark, sf)), _terminals(spark, sf)
    links = br.spanning(pairs, t)
    n = t.groupBy("set").agg(F.count("*").alias("n_terminals"))
    w = links.groupBy("set").agg(F.count("*").alias("links"), F.sum("weight").alias("weight"))
    d = n.join(w, "set", "left")
    return d.select("set", "n_terminals", (F.col("n_terminals") - F.coalesce("links", F.lit(0))).alias("n_trees"), F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))


@query()
def steiner_nodes(spark, sf):
    g = _ground(spark, sf)
    pairs = br.undirected(g)
    at = br.placed(pairs, g.nodes)
    t = br.in_main_component(g.nodes, pairs, _terminals(spark, sf), at)
    return br.steiner_nodes(br.steiner_forest(pairs, t, at), t)


@query("""
, pair AS MATERIALIZED (SELECT DISTINCT b.node_id, b.other FROM both_ways b JOIN nodes x ON x.node_id = b.node_id AND x.node_type IN ('metabolite', 'reaction') AND NOT x.is_currency
  JOIN nodes y ON y.node_id = b.other AND y.node_type IN ('metabolite', 'reaction') AND NOT y.is_currency),
v AS (SELECT CASE WHEN effect_size > 0 THEN 'up' ELSE 'down' END AS s, node_id, CAST(round(abs(effect_size) * 1000) AS BIGINT) AS value FROM evidence WHERE node_id LIKE 'met:%' AND effect_size <> 0),
placed AS (SELECT v.*, row_number() OVER (PARTITION BY s ORDER BY value DESC, node_id) AS k, max(value) OVER (PARTITION BY s) AS top FROM v WHERE node_id IN (SELECT node_id FROM pair)),
able AS MATERIALIZED (SELECT * FROM placed WHERE value >= 0.2 * top),
step AS MATERIALIZED (SELECT DISTINCT a.s, a.k AS i, b.k AS j FROM able a JOIN pair p ON p.node_id = a.node_id JOIN pair q ON q.node_id = p.other JOIN able b ON b.node_id = q.other AND b.s = a.s AND b.k > a.k),
chain AS (SELECT DISTINCT s, 1 AS k FROM able UNION SELECT step.s, step.j FROM chain JOIN step ON step.s = chain.s AND step.i = chain.k),
total AS (SELECT s, sum(value) AS total FROM v GROUP BY 1),
r AS (SELECT s, node_id, value, sum(value) OVER (PARTITION BY s ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto, total FROM chain JOIN able USING (s, k) JOIN total USING (s))
SELECT s AS "set", node_id, CAST(value AS DOUBLE) AS value, round(CAST(upto AS DOUBLE) / CAST(total AS DOUBLE), 6) AS covered FROM r WHERE CAST(upto - value AS DOUBLE) / CAST(total AS DOUBLE) < 0.3
""")
def connected_seeds(spark, sf):
    e = demo.evidence(spark, sf).where(F.col("node_id").startswith("met:") & (F.col("effect_size") != 0))
    v = e.select(F.when(F.col("effect_size") > 0, "up").otherwise("down").alias("set"), "node_id", F.round(F.abs("effect_size") * 1000).alias("value"))
    return sc.rounded(br.connected_seeds(br.undirected(_ground(spark, sf)), v))
