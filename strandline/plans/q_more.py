"""Queries: annotation tables, communities, models of cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factors
from ..operators import models as md
from ..operators import scoring as sc
from ..operators.iterate import cut
from ..sources import annotate as an
from . import demo
from .catalogue import query
from .q_stats import MEASURE, cases, labelled, measure, parts


@query("""
WITH p AS (SELECT CAST(l_linestatus AS VARCHAR) AS tax_a, l_partkey AS gene_a, CASE l_linestatus WHEN 'F' THEN 'O' ELSE 'F' END AS tax_b, l_suppkey AS gene_b FROM lineitem),
s AS (SELECT * FROM p UNION ALL SELECT tax_b, gene_b, tax_a, gene_a FROM p),
g AS (SELECT 'F' AS tax_id, p_partkey AS gene_id, 'F' || (p_partkey % 150) AS symbol FROM part UNION ALL SELECT 'O', p_partkey, 'o' || (p_partkey % 150) FROM part)
SELECT upper(a.symbol) AS symbol, min(b.symbol) AS target_symbol FROM (SELECT DISTINCT gene_a, gene_b FROM s WHERE tax_a = 'F' AND tax_b = 'O') x
JOIN g a ON a.tax_id = 'F' AND a.gene_id = x.gene_a JOIN g b ON b.tax_id = 'O' AND b.gene_id = x.gene_b GROUP BY 1
""", demo=False)
def ortholog_map(spark, sf):
    li, p = demo.read(spark, sf, "lineitem"), demo.read(spark, sf, "part")
    pairs = li.select(F.col("l_linestatus").alias("tax_a"), F.col("l_partkey").alias("gene_a"), F.when(F.col("l_linestatus") == "F", "O").otherwise("F").alias("tax_b"), F.col("l_suppkey").alias("gene_b"))
    gene = lambda t, s: p.select(F.lit(t).alias("tax_id"), F.col("p_partkey").alias("gene_id"), F.concat(F.lit(s), F.col("p_partkey") % 150).alias("symbol"))
    return an.orthologs(pairs, gene("F", "F").unionByName(gene("O", "o")), "F", "O")


@query("""
WITH t AS (SELECT l_partkey AS cid, lower(l_returnflag || l_linestatus || (l_suppkey % 7)) AS s, min(l_linenumber) AS place FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY place, s) AS r FROM t)
SELECT p_partkey AS cid, array_to_string(list_sort(list_distinct(list_append(list(r.s) FILTER (WHERE r.s IS NOT NULL), lower(any_value(p_brand))))), ';') AS synonyms FROM part LEFT JOIN r ON r.cid = p_partkey AND r.r <= 5 GROUP BY p_partkey
""", demo=False)
def synonym_union(spark, sf):
    li = demo.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("cid"), F.concat("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 7).cast("string")).alias("synonym"), F.col("l_linenumber").alias("place"))
    n = demo.read(spark, sf, "part").select(F.col("p_partkey").alias("cid"), F.array("p_brand").alias("synonyms"))
    return an.add_synonyms(n, li, "cid", 5).select("cid", F.array_join("synonyms", ";").alias("synonyms"))


_COMMUNITY = """
WITH ab AS (SELECT 'tax ' || l_suppkey AS taxon, l_linenumber AS sample_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2),
tx AS (SELECT taxon, avg(value) AS mean_abundance FROM ab GROUP BY 1),
ex AS (SELECT 'tax ' || l_suppkey AS taxon, 'm' || l_partkey AS vmh_id, l_orderkey AS reaction, CASE l_returnflag WHEN 'R' THEN 'consumes' ELSE 'produces' END AS role, l_discount AS weight FROM lineitem),
e AS (SELECT 'taxon:tax_' || split_part(taxon, ' ', 2) AS src, 'met:' || substr(vmh_id, 2) AS dst, max(weight) AS weight, CASE WHEN count(DISTINCT role) = 1 THEN any_value(role) ELSE 'bidirectional' END AS role FROM ex JOIN tx USING (taxon) WHERE CAST(substr(vmh_id, 2) AS BIGINT) IN (SELECT p_partkey FROM part WHERE p_size > 12) GROUP BY 1, 2)
"""


def _community(spark, sf):
    li = demo.read(spark, sf, "lineitem")
    taxon = F.concat(F.lit("tax "), "l_suppkey")
    ab = li.groupBy(taxon.alias("taxon"), F.col("l_linenumber").alias("sample_id")).agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("value"))
    ex = li.select(taxon.alias("taxon"), F.concat(F.lit("m"), "l_partkey", F.lit("[e]")).alias("vmh_met"), F.col("l_orderkey").alias("reaction"), F.when(F.col("l_returnflag") == "R", "consumes").otherwise("produces").alias("role"), F.col("l_discount").alias("weight"))
    vmh = demo.read(spark, sf, "part").where("p_size > 12").select(F.concat(F.lit("m"), "p_partkey").alias("vmh_id"), F.concat(F.lit("met:"), "p_partkey").alias("node_id"))
    return an.community(ex, ab, vmh)


@query(_COMMUNITY + "SELECT src, dst, round(weight, 6) AS weight, role FROM e", demo=False)
def community_edges(spark, sf):
    return sc.rounded(_community(spark, sf)[1].drop("reactions"))


@query(_COMMUNITY + "SELECT 'taxon:tax_' || split_part(taxon, ' ', 2) AS node_id, round(mean_abundance, 6) AS mean_abundance FROM tx", demo=False)
def community_taxa(spark, sf):
    return sc.rounded(_community(spark, sf)[0].select("node_id", "mean_abundance"))


@query(_COMMUNITY + """
, w AS (SELECT dst, max(weight) AS w FROM e GROUP BY 1), m AS (SELECT p_brand AS pathway_id, 'met:' || p_partkey AS node_id FROM part)
SELECT pathway_id, round(avg(coalesce(w, 0.0)), 6) AS weight FROM m LEFT JOIN w ON w.dst = m.node_id GROUP BY 1
""", demo=False)
def community_capacity(spark, sf):
    m = demo.read(spark, sf, "part").select(F.col("p_brand").alias("pathway_id"), F.concat(F.lit("met:"), "p_partkey").alias("node_id"))
    return sc.rounded(an.capacity(m, _community(spark, sf)[1]))


@query("""
WITH a AS (SELECT conv_id AS pmid, unnest(string_split_regex(lower(text), '[^a-z]+')) AS chemical FROM conversations)
SELECT chemical, count(DISTINCT pmid) AS n_articles FROM a WHERE chemical NOT IN ('water', 'oxygen', 'drug', 'acid', '') GROUP BY 1
""", demo=False)
def literature_counts(spark, sf):
    a = demo.read(spark, sf, "conversations").select(F.col("conv_id").alias("pmid"), F.split(F.lower("text"), "[^a-z]+").alias("chemicals"))
    return an.chemical_hits(a)


@query(f"""WITH {MEASURE.strip()},
r AS (SELECT sample_id, feature_id, rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0 AS r FROM measure)
SELECT x.feature_id AS a, y.feature_id AS b, round(corr(x.r, y.r), 6) AS rho FROM r x JOIN r y ON x.sample_id = y.sample_id AND x.feature_id < y.feature_id GROUP BY 1, 2 HAVING count(*) > 2 AND abs(corr(x.r, y.r)) >= 0.5 - 1e-12
""", demo=False)
def correlation_edges(spark, sf):
    return sc.rounded(md.correlation_edges(measure(spark, sf, "feature_id")))


@query(f"""WITH {MEASURE.strip()},
d AS (SELECT feature_id, is_case, rank() OVER (PARTITION BY feature_id ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, value) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY feature_id, is_case ORDER BY value) + (count(*) OVER (PARTITION BY feature_id, is_case, value) - 1) / 2.0 AS o,
  count(*) FILTER (WHERE is_case) OVER (PARTITION BY feature_id) AS m, count(*) FILTER (WHERE NOT is_case) OVER (PARTITION BY feature_id) AS n FROM lab),
v AS (SELECT feature_id, is_case, m, n, CASE WHEN is_case THEN (a - o) / n ELSE 1 - (a - o) / m END AS v FROM d WHERE m > 0 AND n > 0)
SELECT feature_id, round(avg(v) FILTER (WHERE is_case), 6) AS auc, round(sqrt(coalesce(var_samp(v) FILTER (WHERE is_case), 0.0) / any_value(m) + coalesce(var_samp(v) FILTER (WHERE NOT is_case), 0.0) / any_value(n)), 6) AS se FROM v GROUP BY feature_id
""", demo=False)
def delong_intervals(spark, sf):
    return sc.rounded(md.delong(labelled(spark, sf), ["feature_id"], "value", "is_case").select("feature_id", "auc", "se"))


@query("""
WITH m AS (SELECT s_nationkey AS module, s_suppkey AS node_id FROM supplier), p AS (SELECT DISTINCT l_suppkey AS node_id, l_quantity AS pathway_id FROM lineitem),
c AS (SELECT module, pathway_id, count(*) AS n FROM m JOIN p USING (node_id) GROUP BY 1, 2), s AS (SELECT module, count(DISTINCT node_id) AS size FROM m GROUP BY 1),
q AS (SELECT module, n, n / sum(n) OVER (PARTITION BY module) AS p FROM c)
SELECT module, round(max(n) / any_value(size), 6) AS purity, round(-sum(p * ln(p)), 6) AS entropy FROM q JOIN s USING (module) GROUP BY module
""", demo=False)
def module_coherence(spark, sf):
    m = demo.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("module"), F.col("s_suppkey").alias("node_id"))
    p = demo.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("node_id"), F.col("l_quantity").alias("pathway_id")).distinct()
    return sc.rounded(md.coherence(m, p)).select("module", "purity", F.when(F.col("entropy") == 0, 0.0).otherwise(F.col("entropy")).alias("entropy"))


def _by_brand(spark, sf):
    """All measurements, summed over the brand of the part; blocks are the sizes' halves, cohorts fifths of the nations."""
    p = demo.read(spark, sf, "part").select(F.col("p_partkey").alias("part"), "p_brand", F.when(F.col("p_size") > 25, "large").otherwise("small").alias("block"))
    # dealt by part for the brands, then by sample for all that follows
    d = measure(spark, sf, "feature_id").withColumnRenamed("feature_id", "part").join(p, "part").select("sample_id", "block", F.concat("block", F.lit(":"), "p_brand").alias("feature_id"), "value")
    d = d.repartition(parts(spark, sf), "sample_id").join(cases(spark, sf), "sample_id")
    keys = [(F.col("cohort") % 5).alias("cohort"), "block", "sample_id", "feature_id"]
    return d.groupBy(*keys).agg(F.sum("value").alias("value"), F.first("is_case").alias("is_case"))


@query(None)
def plsda_loadings(spark, sf):
    return md.plsda(_by_brand(spark, sf), ["cohort"])


@query(None)
def multiblock_loadings(spark, sf):
    return md.multiblock(_by_brand(spark, sf), ["cohort"], keep=10)


@query(None)
def matched_null(spark, sf):
    g = demo.graph(spark, sf)
    d = cut(g.reaction_degree().withColumnRenamed("degree", "value"))  # for candidates, cuts, sizes and places
    q = d.join(g.currency_nodes().select("node_id"), "node_id", "left_semi")
    return md.matched_null(d, q, draws=50)


@query(None)
def loo_stability(spark, sf):
    e = demo.read(spark, sf, "embeddings").select(F.col("vec_id").alias("patient_id"), F.posexplode("embedding").alias("node", "value"))
    return md.loo_stability(e.withColumn("value", F.col("value").cast("double")))


@query(None)
def factor_explained(spark, sf):
    d = _by_brand(spark, sf).select("block", "sample_id", "feature_id", "value")
    return factors.fit(d, 3, sparsity=0.01, rounds=10)[2]
