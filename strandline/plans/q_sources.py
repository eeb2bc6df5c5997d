"""Queries: what readers do after reading, on the driver's tables; and quality figures of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as nm
from ..operators import qc
from ..operators import scoring as sc
from ..sources import tables as tb
from . import demo
from .catalogue import query


@query("""
WITH t AS (SELECT 'part ' || l_partkey AS feature, CAST(round(l_discount * 100) AS BIGINT) - 5 AS effect, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax END AS p FROM lineitem),
f AS (SELECT * FROM t WHERE p IS NULL OR p <= 0.04), m AS (SELECT 'part ' || p_partkey AS feature, 'met:' || p_partkey AS node_id FROM part WHERE p_size > 25)
SELECT node_id, count(*) AS n_records, round(avg(effect), 6) AS mean_effect FROM f JOIN m USING (feature) GROUP BY node_id
""", demo=False)
def evidence_binding(spark, sf):
    li, p = demo.read(spark, sf, "lineitem"), demo.read(spark, sf, "part")
    t = li.select(F.concat(F.lit("part "), "l_partkey").alias("Metabolite"), (F.round(F.col("l_discount") * 100).cast("long") - 5).alias("Log2_FC"), F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("PVALUE"))
    m = p.where("p_size > 25").select(F.concat(F.lit("part "), "p_partkey").alias("feature_id"), F.concat(F.lit("met:"), "p_partkey").alias("node_id"), F.lit(1.0).alias("confidence"))
    e = tb.evidence(t, m, keep_unmapped=False, p_most=0.04)
    return sc.rounded(e.groupBy("node_id").agg(F.count("*").alias("n_records"), F.avg("effect_size").alias("mean_effect")))


@query("""
WITH d AS (SELECT 'HP:' || l_partkey AS hpo_id, 'OMIM:' || l_suppkey AS database_id, CASE WHEN l_returnflag = 'R' THEN 'NOT' END AS qualifier FROM lineitem),
m AS (SELECT 'OMIM:' || s_suppkey AS xref, 'MONDO:' || s_nationkey AS mondo_id FROM supplier WHERE s_acctbal > 0)
SELECT DISTINCT hpo_id, coalesce(mondo_id, database_id) AS disease_id FROM d LEFT JOIN m ON xref = database_id WHERE coalesce(qualifier, '') <> 'NOT'
""", demo=False)
def phenotype_diseases(spark, sf):
    li, s = demo.read(spark, sf, "lineitem"), demo.read(spark, sf, "supplier")
    d = li.select(F.concat(F.lit("HP:"), "l_partkey").alias("hpo_id"), F.concat(F.lit("OMIM:"), "l_suppkey").alias("database_id"), F.when(F.col("l_returnflag") == "R", "not").alias("qualifier"))
    m = s.where("s_acctbal > 0").select(F.concat(F.lit("OMIM:"), "s_suppkey").alias("xref"), F.concat(F.lit("MONDO:"), "s_nationkey").alias("mondo_id"))
    return tb.phenotype_diseases(d, m)


@query("""
SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1
""", demo=False)
def json_attributes(spark, sf):
    e = demo.read(spark, sf, "events").withColumn("a", F.from_json("props", "k long"))
    return sc.rounded(e.groupBy(F.col("a.k").alias("k")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")))


@query("""
WITH d AS (SELECT 'gene:' || l_suppkey AS gene_id, 'drug:' || l_partkey AS drug_id, l_linenumber AS max_phase, l_returnflag AS action FROM lineitem)
SELECT gene_id, drug_id, max(max_phase) AS max_phase, arg_max(action, (max_phase, action)) AS action FROM d GROUP BY 1, 2
""", demo=False)
def drug_mechanisms(spark, sf):
    li = demo.read(spark, sf, "lineitem")
    g = demo.read(spark, sf, "supplier").select(F.concat(F.lit("gene:"), "s_suppkey").alias("node_id"), F.col("s_suppkey").cast("string").alias("symbol"))
    d = li.select(F.col("l_suppkey").cast("string").alias("gene_symbol"), F.concat(F.lit("drug:"), "l_partkey").alias("drug_id"), F.col("l_linenumber").alias("max_phase"), F.col("l_returnflag").alias("action"))
    return tb.mechanisms(d, g)


@query("""
WITH d AS (SELECT l_suppkey AS disease_id, l_partkey AS gene_id, max(l_discount) * 10 AS score FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY disease_id ORDER BY score DESC, gene_id) AS r FROM d WHERE score >= 0.3)
SELECT disease_id, gene_id, round(score, 6) AS score FROM r WHERE r <= 25
""", demo=False)
def disease_genes_top(spark, sf):
    d = demo.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("disease_id"), F.col("l_partkey").alias("gene_id")).agg((F.max("l_discount") * 10).alias("score"))
    return sc.rounded(tb.associations(d, 0.3, 25))


@query("""
SELECT s_suppkey AS k, lower(m) AS metric, round(v, 6) AS value FROM supplier UNPIVOT INCLUDE NULLS (v FOR m IN (s_acctbal)) WHERE v IS NOT NULL
""", demo=False)
def wide_to_long(spark, sf):
    s = demo.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    return sc.rounded(tb.unpivoted(s, "k", "metric"))


@query("""
SELECT p_partkey AS k, CASE WHEN lower(trim(v)) IN ('', 'nan', 'na', 'none', 'null') THEN NULL ELSE trim(v) END AS cleaned, CASE WHEN NOT isnan(TRY_CAST(v AS DOUBLE)) THEN TRY_CAST(v AS DOUBLE) END AS number
FROM (SELECT p_partkey, [' NA ', 'nan', '3.5', 'x', ''][CAST(p_partkey % 5 + 1 AS INTEGER)] AS v FROM part)
""", demo=False)
def clean_values(spark, sf):
    v = F.element_at(F.array(*map(F.lit, (" NA ", "nan", "3.5", "x", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    p = demo.read(spark, sf, "part").select(F.col("p_partkey").alias("k"), v.alias("v"))
    return p.select("k", nm.clean("v").alias("cleaned"), nm.number("v").alias("number"))


@query("""
, k AS MATERIALIZED (SELECT node_id, node_type, is_currency, pathways, compartment FROM nodes),
e AS MATERIALIZED (SELECT s.node_type AS st, d.node_type AS dt, s.node_id AS src, d.node_id AS dst, (s.node_type = 'metabolite' AND s.is_currency) OR (d.node_type = 'metabolite' AND d.is_currency) AS cur
  FROM edges x JOIN k s ON s.node_id = x.src JOIN k d ON d.node_id = x.dst),
pair AS MATERIALIZED (SELECT src AS met, dst AS rxn, 1 AS side FROM e WHERE st = 'metabolite' AND dt = 'reaction' UNION ALL SELECT dst, src, 2 FROM e WHERE st = 'reaction' AND dt = 'metabolite'),
m AS MATERIALIZED (SELECT node_id, is_currency, coalesce(sides, 0) AS sides, coalesce(degree, 0) AS degree FROM k LEFT JOIN (SELECT met, count(DISTINCT side) AS sides, count(DISTINCT rxn) AS degree FROM pair GROUP BY 1) ON met = node_id WHERE node_type = 'metabolite'),
r AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS place, count(*) OVER () AS n FROM m)
SELECT metric, round(CAST(value AS DOUBLE), 9) AS value FROM (
  SELECT 'n_' || t || 's' AS metric, (SELECT count(*) FROM k WHERE node_type = t) AS value FROM (VALUES ('metabolite'), ('reaction'), ('disease'), ('gene')) x(t)
  UNION ALL SELECT 'n_edges', count(*) FROM e UNION ALL SELECT 'currency_edge_fraction', avg(CASE WHEN cur THEN 1.0 ELSE 0.0 END) FROM e
  UNION ALL SELECT 'disease_' || t || '_edges', (SELECT count(*) FROM e WHERE st = 'disease' AND dt = t) FROM (VALUES ('metabolite'), ('reaction'), ('gene')) x(t)
  UNION ALL SELECT 'n_currency', count(*) FILTER (WHERE is_currency) FROM m UNION ALL SELECT 'dead_ends', count(*) FILTER (WHERE NOT is_currency AND sides < 2) FROM m
  UNION ALL SELECT 'orphan_reactions', (SELECT count(*) FROM k WHERE node_type = 'reaction') - (SELECT count(*) FROM (SELECT rxn FROM pair GROUP BY 1 HAVING count(DISTINCT side) = 2))
  UNION ALL SELECT 'degree_mean', avg(degree) FROM m UNION ALL SELECT 'degree_max', max(degree) FROM m UNION ALL SELECT 'degree_p95', degree FROM r WHERE place = floor(0.95::DOUBLE * n)
  UNION ALL SELECT 'reactions_with_pathways', avg(CASE WHEN len(pathways) > 0 THEN 1.0 ELSE 0.0 END) FROM k WHERE node_type = 'reaction'
  UNION ALL SELECT 'n_compartments', count(DISTINCT compartment) FROM k WHERE node_type = 'metabolite' AND compartment <> '')
""")
def graph_qc_readiness(spark, sf):
    return sc.rounded(qc.readiness(demo.graph(spark, sf)), 9)
