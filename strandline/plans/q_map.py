"""Queries: identifiers, names, resolution, lipids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lipids, names as nm
from ..graph import Graph
from ..operators import resolve as rs
from . import demo
from .catalogue import query


@query("""
WITH d AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'chebi:' || p_partkey WHEN 1 THEN 'HMDB' || p_partkey WHEN 2 THEN 'CID:' || p_partkey WHEN 3 THEN CAST(p_partkey AS VARCHAR) ELSE ' CHEBI_' || p_partkey END AS s FROM part)
SELECT k, 'CHEBI:' || nullif(regexp_extract(trim(s), '(?i)^chebi[:\\s_]?(\\d+)', 1), '') AS chebi,
  CASE WHEN starts_with(upper(trim(s)), 'HMDB') THEN 'HMDB' || CASE WHEN length(trim(s)) < 11 THEN lpad(substr(upper(trim(s)), 5), 7, '0') ELSE substr(upper(trim(s)), 5) END END AS hmdb,
  coalesce(nullif(regexp_extract(trim(s), '(?i)^(?:pubchem[:\\s_]?|cid[:\\s_]?)(\\d+)', 1), ''), CASE WHEN regexp_full_match(trim(s), '\\d+') THEN trim(s) END) AS pubchem FROM d
""", demo=False)
def identifier_forms(spark, sf):
    k = F.col("p_partkey")
    s = F.when(k % 5 == 0, F.concat(F.lit("chebi:"), k)).when(k % 5 == 1, F.concat(F.lit("HMDB"), k)).when(k % 5 == 2, F.concat(F.lit("CID:"), k)).when(k % 5 == 3, k.cast("string")).otherwise(F.concat(F.lit(" CHEBI_"), k))
    return demo.read(spark, sf, "part").select(k.alias("k"), s.alias("s")).select("k", nm.chebi("s").alias("chebi"), nm.hmdb("s").alias("hmdb"), nm.pubchem("s").alias("pubchem"))


_SALT = """
WITH d AS (SELECT p_partkey AS k, lower(split_part(p_name, ' ', 1)) || CASE p_partkey % 4 WHEN 0 THEN 'ate' WHEN 1 THEN 'ic acid' WHEN 2 THEN 'oic acid' ELSE 'ite' END AS s FROM part)
SELECT k, s, CASE WHEN s LIKE '%ate' THEN left(s, length(s) - 3) || 'ic acid,' || left(s, length(s) - 3) || 'oic acid'
  WHEN s LIKE '%oic acid' THEN left(s, length(s) - 8) || 'oate' WHEN s LIKE '%ic acid' THEN left(s, length(s) - 7) || 'ate' ELSE left(s, length(s) - 3) || 'ous acid' END AS variants FROM d
"""


@query(_SALT, demo=False)
def salt_variants(spark, sf):
    k = F.col("p_partkey")
    end = F.when(k % 4 == 0, "ate").when(k % 4 == 1, "ic acid").when(k % 4 == 2, "oic acid").otherwise("ite")
    d = demo.read(spark, sf, "part").select(k.alias("k"), F.concat(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))), end).alias("s"))
    return d.select("k", "s", F.array_join(nm.salt_variants("s"), ",").alias("variants"))


@query("""
WITH d AS (SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'L-' WHEN 1 THEN '(R)-alpha-' WHEN 2 THEN 'cis-D-' ELSE '' END || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' / ' || p_brand ELSE '' END AS s FROM part)
SELECT k, CASE k % 4 WHEN 0 THEN substr(s, 3) WHEN 1 THEN substr(s, 11) WHEN 2 THEN substr(s, 7) ELSE s END AS bare, CASE WHEN k % 3 = 0 THEN 3 ELSE 1 END AS n_variants FROM d
""", demo=False)
def name_variants(spark, sf):
    k = F.col("p_partkey")
    pre = F.when(k % 4 == 0, "L-").when(k % 4 == 1, "(R)-alpha-").when(k % 4 == 2, "cis-D-").otherwise("")
    d = demo.read(spark, sf, "part").select(k.alias("k"), F.concat(pre, "p_name", F.when(k % 3 == 0, F.concat(F.lit(" / "), "p_brand")).otherwise("")).alias("s"))
    return d.select("k", nm.without_stereo("s").alias("bare"), F.size(nm.split_variants("s")).alias("n_variants"))


def _chem(spark, sf) -> Graph:
    g = demo.graph(spark, sf)
    k = F.split_part("node_id", F.lit(":"), F.lit(2)).cast("long")
    met = F.col("node_type") == "metabolite"
    n = g.nodes.withColumns({"chebi_id": F.when(met, F.concat(F.lit("CHEBI:"), k)), "hmdb_id": F.when(met & (k % 2 == 0), F.concat(F.lit("HMDB"), k)), "pubchem_cid": F.when(met, (k + 1_000_000).cast("string")), "symbol": F.when(F.col("node_type") == "gene", F.col("name"))})
    return Graph(n, g.edges, g.at_reactions)


@query("""
, linked AS (SELECT DISTINCT b.node_id FROM both_ways b JOIN nodes r ON r.node_id = b.other AND r.node_type = 'reaction'),
m AS (SELECT node_id, lower(name) AS nk, CAST(split_part(node_id, ':', 2) AS BIGINT) AS k, CASE WHEN l.node_id IS NOT NULL THEN 0 ELSE 2 END AS bucket FROM nodes LEFT JOIN linked l USING (node_id) WHERE node_type = 'metabolite'),
f AS (SELECT DISTINCT CASE l_partkey % 5 WHEN 0 THEN 'chebi:' || l_partkey WHEN 1 THEN 'HMDB' || (l_partkey - 1) WHEN 2 THEN CAST(l_partkey + 1000000 AS VARCHAR) WHEN 3 THEN 'met:' || l_partkey ELSE 'nothing ' || l_partkey END AS feature_id, l_partkey % 5 AS kind, l_partkey AS p FROM lineitem)
SELECT f.feature_id, m.node_id, CASE WHEN m.node_id IS NULL THEN NULL WHEN kind = 2 THEN CAST(0.85 AS DOUBLE) ELSE 1.0 END AS confidence, CASE WHEN m.node_id IS NULL THEN NULL ELSE ['chebi', 'hmdb', 'pubchem', 'id', ''][kind + 1] END AS tier
FROM f LEFT JOIN m ON (kind IN (0, 2, 3) AND m.k = f.p) OR (kind = 1 AND m.k = f.p - 1 AND m.k % 2 = 0)
""")
def map_metabolites(spark, sf):
    p = F.col("l_partkey")
    fid = F.when(p % 5 == 0, F.concat(F.lit("chebi:"), p)).when(p % 5 == 1, F.concat(F.lit("HMDB"), p - 1)).when(p % 5 == 2, (p + 1_000_000).cast("string")).when(p % 5 == 3, F.concat(F.lit("met:"), p)).otherwise(F.concat(F.lit("nothing "), p))
    f = demo.read(spark, sf, "lineitem").select(fid.alias("feature_id")).distinct()
    return rs.map_metabolites(f, rs.metabolite_index(_chem(spark, sf)))


@query("""
, g AS (SELECT node_id, upper(name) AS s FROM nodes WHERE node_type = 'gene'),
f AS (SELECT s_suppkey AS k, CASE s_suppkey % 3 WHEN 0 THEN 'gene:' || s_suppkey WHEN 1 THEN 'symbol:' || lower(s_name) ELSE s_name END AS feature_id FROM supplier)
SELECT feature_id, 'gene:' || k AS node_id, CAST(CASE WHEN k % 3 = 2 THEN 0.95 ELSE 1.0 END AS DOUBLE) AS confidence FROM f
""")
def map_genes(spark, sf):
    k = F.col("s_suppkey")
    f = demo.read(spark, sf, "supplier").select(F.when(k % 3 == 0, F.concat(F.lit("gene:"), k)).when(k % 3 == 1, F.concat(F.lit("symbol:"), F.lower("s_name"))).otherwise(F.col("s_name")).alias("feature_id"))
    return rs.map_genes(f, rs.gene_index(_chem(spark, sf)))


@query("""
WITH x AS (SELECT l_orderkey AS hub, 'chebi:' || l_partkey AS source, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS seq FROM lineitem
  UNION ALL SELECT o_orderkey, 'hmdb:' || o_custkey, 1000000000 + o_orderkey FROM orders)
SELECT split_part(a.source, ':', 2) AS left_id, arg_min(split_part(b.source, ':', 2), a.hub) AS right_id FROM x a JOIN x b ON a.hub = b.hub WHERE starts_with(a.source, 'chebi:') AND starts_with(b.source, 'hmdb:') GROUP BY 1
""", demo=False)
def xref_hub_join(spark, sf):
    li = demo.read(spark, sf, "lineitem")
    x = li.select(F.col("l_orderkey").alias("hub"), F.concat(F.lit("chebi:"), "l_partkey").alias("source"), F.col("l_orderkey").alias("seq"))
    y = demo.read(spark, sf, "orders").select(F.col("o_orderkey").alias("hub"), F.concat(F.lit("hmdb:"), "o_custkey").alias("source"), F.col("o_orderkey").alias("seq"))
    return rs.via_hub(x.unionByName(y), "chebi", "hmdb")


@query("""
WITH p AS (SELECT a.s_name AS a, b.s_name AS b, (l_partkey * 7 + l_linenumber * 131) % 1000 AS score FROM lineitem JOIN supplier a ON a.s_suppkey = l_suppkey JOIN supplier b ON b.s_suppkey = (l_partkey * 13) % (SELECT count(*) FROM supplier)),
u AS (SELECT least(upper(a), upper(b)) AS a, greatest(upper(a), upper(b)) AS b, max(score) / 1000 AS score FROM p WHERE score >= 400 AND upper(a) <> upper(b) GROUP BY 1, 2),
e AS (SELECT 'gene:' || x.s_suppkey AS src, 'gene:' || y.s_suppkey AS dst, score FROM u JOIN supplier x ON upper(x.s_name) = u.a JOIN supplier y ON upper(y.s_name) = u.b)
SELECT src, dst, round(score, 6) AS score FROM e UNION ALL SELECT dst, src, round(score, 6) FROM e
""", demo=False)
def ppi_edges(spark, sf):
    s, li = demo.read(spark, sf, "supplier"), demo.read(spark, sf, "lineitem")
    n = s.agg(F.count("*").alias("n"))
    a, b = s.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("a")), s.select(F.col("s_suppkey").alias("k2"), F.col("s_name").alias("b"))
    p = li.crossJoin(n).withColumn("k2", (F.col("l_partkey") * 13) % F.col("n")).join(a, "l_suppkey").join(b, "k2").select("a", "b", ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 131) % 1000).alias("score"))
    return rs.ppi_edges(p, _chem(spark, sf).of_type("gene")).withColumn("score", F.round("score", 6))


@query("""
WITH d AS (SELECT p_partkey AS k, ['PC', 'LPE', 'TG', 'CE'][CAST(p_partkey % 4 + 1 AS INTEGER)] AS sub, p_partkey % 30 + 12 AS c, p_partkey % 5 AS db, CASE WHEN p_partkey % 3 = 0 THEN 'O-' WHEN p_partkey % 3 = 1 THEN 'P-' ELSE '' END AS link FROM part)
SELECT k, sub AS sub_class, ['GP', 'GP', 'GL', 'ST'][CAST(k % 4 + 1 AS INTEGER)] AS category, CAST(c AS INTEGER) AS carbons, CAST(db AS INTEGER) AS double_bonds, CASE link WHEN 'O-' THEN 'ether' WHEN 'P-' THEN 'plasmalogen' ELSE 'acyl' END AS linkage,
  CASE WHEN db = 0 THEN 'SFA' WHEN db = 1 THEN 'MUFA' ELSE 'PUFA' END AS saturation, CASE WHEN c < 14 THEN 'short' WHEN c <= 18 THEN 'medium' WHEN c <= 22 THEN 'long' ELSE 'very_long' END AS chain_bin FROM d
""", demo=False)
def lipid_parse(spark, sf):
    k = F.col("p_partkey")
    sub = F.element_at(F.array(*map(F.lit, ("PC", "LPE", "TG", "CE"))), (k % 4 + 1).cast("int"))
    link = F.when(k % 3 == 0, "O-").when(k % 3 == 1, "P-").otherwise("")
    d = demo.read(spark, sf, "part").select(k.alias("k"), F.concat(sub, F.lit(" "), link, k % 30 + 12, F.lit(":"), k % 5).alias("name")).withColumn("l", lipids.parse("name"))
    return d.select("k", "l.sub_class", "l.category", "l.carbons", "l.double_bonds", "l.linkage", lipids.saturation(F.col("l.double_bonds")).alias("saturation"), lipids.chain_bin(F.col("l.carbons")).alias("chain_bin"))


@query(None)
def fuzzy_names(spark, sf):
    g = _chem(spark, sf)
    f = g.of_type("metabolite").select(F.concat(F.lower("name"), F.lit("x")).alias("feature_id")).distinct()
    return rs.fuzzy(f, rs.metabolite_index(g))
