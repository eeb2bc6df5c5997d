"""The driver's tables seen as a graph, evidence and measurements (the same as SQL in ``DEMO_SQL``).

Orders are reactions, parts metabolites, suppliers genes, nations diseases. A line
of status F makes its part a substrate of its order, of status O a product, and
its supplier a catalyst. Effects and confidences come from whole numbers (percent),
so they are equal in any engine to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.iterate import laid, portions


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def graph(spark: SparkSession, sf: str) -> Graph:
    o, p, s, n = (read(spark, sf, t) for t in ("orders", "part", "supplier", "nation"))
    li = read(spark, sf, "lineitem")
    none = F.lit(None).cast("string")
    rxn = o.select(
        F.concat(F.lit("rxn:"), "o_orderkey").alias("node_id"),
        F.lit("reaction").alias("node_type"),
        none.alias("name"),
        (F.col("o_orderpriority") == "1-URGENT").alias("reversible"),
        F.lit(False).alias("is_currency"),
        none.alias("compartment"),
        F.array("o_orderpriority", "o_orderstatus").alias("pathways"),
    )
    no_paths = F.lit(None).cast("array<string>").alias("pathways")
    met = p.select(
        F.concat(F.lit("met:"), "p_partkey").alias("node_id"),
        F.lit("metabolite").alias("node_type"),
        F.col("p_name").alias("name"),
        F.lit(False).alias("reversible"),
        (F.col("p_size") <= 2).alias("is_currency"),
        F.col("p_type").alias("compartment"),
        no_paths,
    )
    other = lambda d, key, kind, name: d.select(
        key.alias("node_id"), F.lit(kind).alias("node_type"), F.col(name).alias("name"), F.lit(False).alias("reversible"), F.lit(False).alias("is_currency"), none.alias("compartment"), no_paths
    )
    gene = other(s, F.concat(F.lit("gene:"), "s_suppkey"), "gene", "s_name")
    dis = other(n, F.concat(F.lit("dis:"), "n_nationkey"), "disease", "n_name")
    n_parts = portions(spark, li.count())
    # dealt once by order: the two edges of a line, and whether the order is there, need no further exchange
    li = li.select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_linestatus") == "F").alias("used")).repartition(n_parts, "l_orderkey")
    of = lambda rel, key: F.struct(F.lit(rel).alias("rel"), F.col(key).alias("key"))
    side = F.when(F.col("used"), of("substrate", "l_partkey")).otherwise(of("product", "l_partkey"))
    e = li.select("l_orderkey", F.explode(F.array(side, of("catalysis", "l_suppkey"))).alias("x")).groupBy("l_orderkey", "x.rel", "x.key").agg(F.lit(1).alias("x"))
    e = e.join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("known")).repartition(n_parts, "l_orderkey").distinct(), "l_orderkey", "left")
    node = F.concat(F.when(F.col("rel") == "catalysis", "gene:").otherwise("met:"), "key")
    order, out = F.concat(F.lit("rxn:"), "l_orderkey"), F.col("rel") == "product"
    e = e.select(F.when(out, order).otherwise(node).alias("src"), F.when(out, node).otherwise(order).alias("dst"), "rel", F.coalesce("known", F.lit(False)).alias("known"))
    dg = s.select(F.concat(F.lit("dis:"), "s_nationkey").alias("src"), F.concat(F.lit("gene:"), "s_suppkey").alias("dst"), F.lit("disease_gene").alias("rel"), F.lit(False).alias("known"))
    # operators read the edges several times, as they would from a bundle: they are laid down once, as columns
    e = laid(e.unionByName(dg))
    out = F.col("rel") == "product"
    near = e.where("known").select(F.when(out, F.col("dst")).otherwise(F.col("src")).alias("node_id"), F.when(out, F.col("src")).otherwise(F.col("dst")).alias("other"), "rel")
    return Graph(rxn.unionByName(met).unionByName(gene).unionByName(dis), e.select("src", "dst", "rel"), near)


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """node_id, effect_size, confidence: percent discount over five, less percent tax."""
    li = read(spark, sf, "lineitem")
    pct = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    parts = [
        li.groupBy(F.concat(F.lit(k), c).alias("node_id")).agg((pct("l_discount") / F.count("*") - 5.0).alias("effect_size"), (1.0 - pct("l_tax") / F.count("*") / 100.0).alias("confidence"))
        for k, c in (("met:", "l_partkey"), ("gene:", "l_suppkey"))
    ]
    return parts[0].unionByName(parts[1])


DEMO_SQL = """
nodes AS (
  SELECT 'rxn:' || o_orderkey AS node_id, 'reaction' AS node_type, CAST(NULL AS VARCHAR) AS name, o_orderpriority = '1-URGENT' AS reversible,
    false AS is_currency, CAST(NULL AS VARCHAR) AS compartment, [o_orderpriority, o_orderstatus] AS pathways FROM orders
  UNION ALL SELECT 'met:' || p_partkey, 'metabolite', p_name, false, p_size <= 2, p_type, NULL FROM part
  UNION ALL SELECT 'gene:' || s_suppkey, 'gene', s_name, false, false, NULL, NULL FROM supplier
  UNION ALL SELECT 'dis:' || n_nationkey, 'disease', n_name, false, false, NULL, NULL FROM nation
), edges AS (
  SELECT DISTINCT CASE WHEN l_linestatus = 'F' THEN 'met:' || l_partkey ELSE 'rxn:' || l_orderkey END AS src,
    CASE WHEN l_linestatus = 'F' THEN 'rxn:' || l_orderkey ELSE 'met:' || l_partkey END AS dst,
    CASE WHEN l_linestatus = 'F' THEN 'substrate' ELSE 'product' END AS rel FROM lineitem
  UNION ALL SELECT DISTINCT 'gene:' || l_suppkey, 'rxn:' || l_orderkey, 'catalysis' FROM lineitem
  UNION ALL SELECT 'dis:' || s_nationkey, 'gene:' || s_suppkey, 'disease_gene' FROM supplier
), evidence AS (
  SELECT 'met:' || l_partkey AS node_id, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) - 5.0 AS effect_size,
    1.0 - CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS confidence FROM lineitem GROUP BY l_partkey
  UNION ALL
  SELECT 'gene:' || l_suppkey, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) - 5.0,
    1.0 - CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 FROM lineitem GROUP BY l_suppkey
), both_ways AS (
  SELECT src AS node_id, dst AS other, rel FROM edges UNION ALL SELECT dst, src, rel FROM edges
), rdegree AS (
  SELECT m.node_id, greatest(count(r.node_id), 1) AS degree FROM nodes m LEFT JOIN both_ways b ON b.node_id = m.node_id
    LEFT JOIN nodes r ON r.node_id = b.other AND r.node_type = 'reaction' WHERE m.node_type = 'metabolite' GROUP BY m.node_id
), contributions AS (
  SELECT e.dst AS reaction_id, 'substrate' AS role, e.src AS node_id, -v.effect_size * v.confidence / sqrt(d.degree) AS c, v.confidence AS confidence
    FROM edges e JOIN nodes m ON m.node_id = e.src AND m.node_type = 'metabolite' AND NOT m.is_currency JOIN rdegree d ON d.node_id = e.src JOIN evidence v ON v.node_id = e.src WHERE e.rel = 'substrate'
  UNION ALL
  SELECT e.src, 'product', e.dst, v.effect_size * v.confidence / sqrt(d.degree), v.confidence
    FROM edges e JOIN nodes m ON m.node_id = e.dst AND m.node_type = 'metabolite' AND NOT m.is_currency JOIN rdegree d ON d.node_id = e.dst JOIN evidence v ON v.node_id = e.dst WHERE e.rel = 'product'
  UNION ALL
  SELECT e.dst, 'gene', e.src, v.effect_size * v.confidence, v.confidence
    FROM edges e JOIN evidence v ON v.node_id = e.src WHERE e.rel = 'catalysis'
), scores AS (
  SELECT c.reaction_id, sum(CASE WHEN n.reversible THEN abs(c.c) ELSE c.c END) / sqrt(count(*)) AS score,
    avg(CASE WHEN c.c > 0 THEN 1.0 ELSE -1.0 END) AS direction, any_value(n.reversible) AS reversible, count(*) AS evidence_count, avg(c.confidence) AS confidence
  FROM contributions c JOIN nodes n ON n.node_id = c.reaction_id GROUP BY c.reaction_id
)
"""
