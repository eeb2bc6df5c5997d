"""Queries: scans, restrictions, aggregates and scores of the demo graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import graph as gr
from ..operators import scoring as sc
from . import demo
from .catalogue import query


@query("""
SELECT reaction_id, round(score, 6) AS score, round(direction, 6) AS direction, reversible, evidence_count, round(confidence, 6) AS confidence FROM scores
""")
def reaction_scores(spark, sf):
    return sc.rounded(sc.score_reactions(demo.graph(spark, sf), demo.evidence(spark, sf)))


@query("""
SELECT c.reaction_id, round(sum(CASE WHEN n.reversible THEN abs(c.c) ELSE c.c END) / sqrt(count(*)), 6) AS score, count(*) AS evidence_count
FROM (SELECT reaction_id, c * 0.5 AS c FROM contributions WHERE role = 'gene' UNION ALL SELECT reaction_id, c FROM contributions WHERE role <> 'gene') c
JOIN nodes n ON n.node_id = c.reaction_id GROUP BY c.reaction_id HAVING count(*) >= 4
""")
def reaction_scores_weighted(spark, sf):
    s = sc.score_reactions(demo.graph(spark, sf), demo.evidence(spark, sf), min_evidence=4, gene_weight=0.5)
    return sc.rounded(s.select("reaction_id", "score", "evidence_count"))


@query("""
, wide AS (SELECT c.*, n.reversible FROM contributions c JOIN nodes n ON n.node_id = c.reaction_id)
SELECT reaction_id, count(*) FILTER (WHERE role <> 'gene' AND (reversible OR c >= 0)) AS n_supporting, count(*) FILTER (WHERE role = 'gene') AS n_genes,
  count(*) FILTER (WHERE role <> 'gene' AND NOT reversible AND c < 0) AS n_contradictory FROM wide GROUP BY reaction_id
""")
def reaction_evidence_detail(spark, sf):
    s = sc.score_reactions(demo.graph(spark, sf), demo.evidence(spark, sf), detail=True)
    size = lambda c: F.size(c).cast("long")
    return s.select("reaction_id", size("supporting_metabolites").alias("n_supporting"), size("supporting_genes").alias("n_genes"), size("contradictory_metabolites").alias("n_contradictory"))


@query("""
, member AS (SELECT node_id AS reaction_id, unnest(pathways) AS pathway_id FROM nodes WHERE node_type = 'reaction'),
s AS (SELECT m.pathway_id, s.* FROM scores s JOIN member m USING (reaction_id)),
stats AS (
  SELECT pathway_id, count(*) AS n_reactions, avg(score) AS mean_score, median(score) AS median_score, coalesce(stddev_samp(score), 0.0) AS sd_score, avg(direction) AS mean_direction,
    CAST(sum(evidence_count) AS BIGINT) AS total_evidence, (CASE WHEN avg(score) >= 0 THEN count(*) FILTER (WHERE score >= 0) ELSE count(*) FILTER (WHERE score < 0) END) / count(*) AS sign_consistency
  FROM s GROUP BY pathway_id
), best AS (
  SELECT pathway_id, string_agg(reaction_id, ',' ORDER BY rn) AS top_reactions FROM (
    SELECT pathway_id, reaction_id, row_number() OVER (PARTITION BY pathway_id ORDER BY abs(round(score, 9)) DESC, reaction_id) AS rn FROM s) WHERE rn <= 5 GROUP BY pathway_id
)
SELECT pathway_id, n_reactions, round(mean_score, 6) AS mean_score, round(median_score, 6) AS median_score, round(sd_score, 6) AS sd_score, round(mean_direction, 6) AS mean_direction,
  total_evidence, round(sign_consistency, 6) AS sign_consistency, top_reactions FROM stats JOIN best USING (pathway_id)
""")
def pathway_summary(spark, sf):
    g = demo.graph(spark, sf)
    # ties broken by id must not depend on the order of sums
    s = sc.score_reactions(g, demo.evidence(spark, sf)).withColumn("score", F.round("score", 9))
    return sc.rounded(sc.summarise_pathways(g, s))


@query("""
SELECT metric, value FROM (
  SELECT node_type AS metric, count(*) AS value FROM nodes GROUP BY 1
  UNION ALL SELECT t, 0 FROM (VALUES ('pathway'), ('phenotype'), ('drug'), ('variant'), ('microbial_taxon')) v(t)
  UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'currency', count(*) FROM nodes WHERE is_currency UNION ALL SELECT 'edges', count(*) FROM edges)
""")
def graph_summary(spark, sf):
    return demo.graph(spark, sf).summary()


@query("SELECT node_id, name FROM nodes WHERE node_type = 'gene'")
def nodes_of_type(spark, sf):
    return demo.graph(spark, sf).of_type("gene").select("node_id", "name")


@query("SELECT node_id FROM nodes WHERE is_currency")
def currency_nodes(spark, sf):
    return demo.graph(spark, sf).currency_nodes().select("node_id")


@query("""
, hub AS (SELECT node_id FROM rdegree, (SELECT avg(degree) + 1.5 * stddev_samp(degree) AS cut FROM rdegree) WHERE degree > cut)
SELECT n.node_id, n.is_currency OR h.node_id IS NOT NULL AS is_currency FROM nodes n LEFT JOIN hub h USING (node_id) WHERE n.node_type = 'metabolite'
""")
def currency_flags(spark, sf):
    from ..operators.currency import hubs

    g = demo.graph(spark, sf)
    return g.flag_currency(hubs(g, 1.5)).of_type("metabolite").select("node_id", "is_currency")


@query("""
, kept AS (SELECT node_id FROM nodes WHERE coalesce(lower(compartment), '') = '' OR starts_with(lower(compartment), 'promo'))
SELECT e.src, e.dst, e.rel FROM edges e JOIN kept a ON a.node_id = e.src JOIN kept b ON b.node_id = e.dst
""")
def filter_by_prefix(spark, sf):
    g = demo.graph(spark, sf)
    return gr.Graph(g.nodes.withColumn("species", F.col("compartment")), g.edges).filter_by_species("PROMO").edges.select("src", "dst", "rel")


@query("""
, m AS MATERIALIZED (SELECT node_id FROM nodes WHERE node_type = 'metabolite' AND NOT is_currency),
e AS MATERIALIZED (SELECT src, dst, rel FROM edges),
lhs AS MATERIALIZED (SELECT DISTINCT e.dst AS node_id FROM e JOIN m ON m.node_id = e.src WHERE e.rel = 'substrate'),
rhs AS MATERIALIZED (SELECT DISTINCT e.src AS node_id FROM e JOIN m ON m.node_id = e.dst WHERE e.rel = 'product'),
k AS MATERIALIZED (SELECT node_id FROM m UNION ALL SELECT n.node_id FROM nodes n JOIN lhs USING (node_id) JOIN rhs USING (node_id) WHERE n.node_type = 'reaction')
SELECT e.src, e.dst, e.rel FROM e JOIN k a ON a.node_id = e.src JOIN k b ON b.node_id = e.dst
""")
def noncurrency_subgraph(spark, sf):
    return demo.graph(spark, sf).noncurrency().edges.select("src", "dst", "rel")


@query("""
, given AS (SELECT node_id FROM nodes WHERE node_type = 'metabolite' AND compartment NOT LIKE 'SMALL%'),
whole AS (SELECT r.node_id FROM nodes r JOIN both_ways b ON b.node_id = r.node_id JOIN nodes m ON m.node_id = b.other AND m.node_type = 'metabolite'
  WHERE r.node_type = 'reaction' GROUP BY r.node_id HAVING bool_and(b.other IN (SELECT node_id FROM given)))
SELECT node_id FROM given UNION ALL SELECT node_id FROM whole
""")
def metabolite_subgraph(spark, sf):
    g = demo.graph(spark, sf)
    return g.metabolite_subgraph(g.of_type("metabolite").where("compartment NOT LIKE 'SMALL%'")).nodes.select("node_id")


@query("""
SELECT DISTINCT b.node_id, b.other FROM both_ways b JOIN nodes n ON n.node_id = b.other AND n.node_type = 'gene' JOIN nodes d ON d.node_id = b.node_id AND d.node_type = 'disease'
""")
def neighbors_1hop(spark, sf):
    g = demo.graph(spark, sf)
    return g.neighbours(g.of_type("disease"), "gene")


@query("SELECT node_id, CAST(degree AS BIGINT) AS degree FROM rdegree")
def reaction_degree(spark, sf):
    return demo.graph(spark, sf).reaction_degree()


@query("SELECT node_id, count(*) AS degree FROM both_ways GROUP BY node_id")
def total_degree(spark, sf):
    return demo.graph(spark, sf).total_degree()


@query("""
, m AS (SELECT DISTINCT unnest(pathways) AS src, node_id AS dst FROM nodes WHERE node_type = 'reaction')
SELECT src, dst, 'pathway_reaction' AS rel FROM m
""")
def promote_pathways(spark, sf):
    return demo.graph(spark, sf).promote_pathways().edges.where("rel = 'pathway_reaction'").select("src", "dst", "rel")


@query("""
, member AS (SELECT node_id, unnest(pathways) AS pathway_id FROM nodes WHERE node_type = 'reaction')
SELECT m.pathway_id, count(DISTINCT b.other) AS n_nodes FROM member m JOIN both_ways b USING (node_id) JOIN nodes n ON n.node_id = b.other AND n.node_type IN ('metabolite', 'gene')
GROUP BY m.pathway_id HAVING count(DISTINCT b.other) BETWEEN 3 AND 1000000
""")
def pathway_sets(spark, sf):
    return demo.graph(spark, sf).pathway_nodes(3, 1_000_000).groupBy("pathway_id").agg(F.count("*").alias("n_nodes"))


@query("SELECT coalesce(compartment, '(none)') AS compartment, count(*) AS n FROM nodes WHERE node_type = 'metabolite' GROUP BY 1")
def compartment_summary(spark, sf):
    return demo.graph(spark, sf).compartment_summary()


@query("""
, n2 AS (SELECT CASE WHEN node_type = 'metabolite' THEN 'met:' || (CAST(split_part(node_id, ':', 2) AS BIGINT) % 50) || '@' || compartment ELSE node_id END AS id, * FROM nodes)
SELECT split_part(id, '@', 1) AS node_id, node_type, count(*) AS merged FROM n2 GROUP BY 1, 2
""")
def collapse_compartments(spark, sf):
    g = demo.graph(spark, sf)
    new = F.when(F.col("node_type") == "metabolite", F.concat(F.lit("met:"), F.split_part("node_id", F.lit(":"), F.lit(2)).cast("long") % 50, F.lit("@"), "compartment")).otherwise(F.col("node_id"))
    n = g.nodes.withColumn("node_id", new)
    merged = n.groupBy(F.substring_index("node_id", "@", 1).alias("node_id")).agg(F.count("*").alias("merged"))
    n = n.withColumns({"chebi_id": F.lit(None).cast("string")})
    c = gr.Graph(n, g.edges.withColumn("confidence", F.lit(1.0))).collapse_compartments()
    return c.nodes.select("node_id", "node_type").join(merged, "node_id")


@query("""
, hit AS (SELECT node_id, unnest(pathways) AS pathway FROM nodes WHERE node_type = 'reaction')
SELECT b.other AS node_id, count(DISTINCT h.pathway) AS n_pathways, array_to_string(list_sort(list_distinct(list(h.pathway))), ';') AS pathways
FROM both_ways b JOIN hit h ON h.node_id = b.node_id AND h.pathway IN ('2-HIGH', 'P') JOIN nodes m ON m.node_id = b.other AND m.node_type = 'metabolite' WHERE b.rel IN ('substrate', 'product') GROUP BY b.other
""")
def metabolites_for_pathways(spark, sf):
    return gr.metabolites_for_pathways(demo.graph(spark, sf), ["2-HIGH", "P"])


@query("""
SELECT node_id FROM nodes WHERE node_type = 'reaction' AND (list_contains(pathways, '5-LOW') OR node_id IN (SELECT dst FROM edges WHERE src IN ('gene:3', 'gene:7'))
  OR node_id IN (SELECT dst FROM edges WHERE rel = 'substrate' AND src IN ('met:5', 'met:6')) OR node_id IN (SELECT src FROM edges WHERE rel = 'product' AND dst IN ('met:5', 'met:6')))
""")
def composite_anchor(spark, sf):
    return sc.composite_anchor(demo.graph(spark, sf), ["5-LOW"], ["gene:3", "gene:7"], ["met:5", "met:6"])


@query("SELECT node_id, name FROM nodes WHERE contains(lower(node_id), 'gene:1') OR contains(lower(coalesce(name, '')), 'gene:1') ORDER BY node_id LIMIT 80")
def search_nodes(spark, sf):
    return gr.search_nodes(demo.graph(spark, sf), "Gene:1").select("node_id", "name")


@query("""
, gate AS (SELECT e.dst AS reaction_id, CASE WHEN v.effect_size >= 0 THEN 1.0 WHEN v.effect_size <= -0.5 THEN 0.3 ELSE 0.3 + 0.7 * (1 - v.effect_size / -0.5) END AS gate
  FROM edges e JOIN evidence v ON v.node_id = e.src WHERE e.rel = 'catalysis')
SELECT s.reaction_id, round(coalesce(g.lo, 1.0), 6) AS gate, round(s.score * coalesce(g.lo, 1.0), 6) AS gated_score, round(g.gm, 6) AS geometric
FROM scores s LEFT JOIN (SELECT reaction_id, min(gate) AS lo, exp(avg(ln(gate))) AS gm FROM gate GROUP BY 1) g USING (reaction_id)
""")
def enzyme_gate(spark, sf):
    g, e = demo.graph(spark, sf), demo.evidence(spark, sf)
    gated = sc.apply_gate(sc.score_reactions(g, e), sc.enzyme_gate(g, e, also=("mean",)))
    return sc.rounded(gated.select("reaction_id", "gate", "gated_score", F.col("mean").alias("geometric")))


_DRUGS = """
, drug AS (SELECT 'gene:' || l_suppkey AS gene_id, 'drug:' || l_partkey AS drug_id, max(l_linenumber % 6 - 1) AS max_phase FROM lineitem GROUP BY 1, 2),
dscore AS (SELECT gene_id, CASE max(max_phase) WHEN 4 THEN 1.0 WHEN 3 THEN 0.75 WHEN 2 THEN 0.55 WHEN 1 THEN 0.3 WHEN 0 THEN 0.1 ELSE 0.05 END AS druggability,
  count(DISTINCT drug_id) AS n_drugs, count(DISTINCT drug_id) FILTER (WHERE max_phase = 4) AS n_approved FROM drug GROUP BY gene_id)
"""


def _drugs(spark, sf):
    li = demo.read(spark, sf, "lineitem")
    return li.groupBy(F.concat(F.lit("gene:"), "l_suppkey").alias("gene_id"), F.concat(F.lit("drug:"), "l_partkey").alias("drug_id")).agg(F.max(F.col("l_linenumber") % 6 - 1).alias("max_phase"))


@query(_DRUGS + "SELECT gene_id, CAST(druggability AS DOUBLE) AS druggability, n_drugs, n_approved FROM dscore")
def druggability(spark, sf):
    return sc.druggability(_drugs(spark, sf)).drop("best_drug")


@query(_DRUGS + """
, best AS (SELECT e.dst AS reaction_id, max(d.druggability) AS best FROM edges e JOIN nodes g ON g.node_id = e.src AND g.node_type = 'gene' JOIN nodes r ON r.node_id = e.dst AND r.node_type = 'reaction'
  JOIN dscore d ON d.gene_id = e.src GROUP BY 1),
used AS (SELECT e.src AS met, e.dst AS reaction_id, m.is_currency FROM edges e JOIN nodes m ON m.node_id = e.src AND m.node_type = 'metabolite' WHERE e.rel = 'substrate'),
users AS (SELECT met, count(*) AS n FROM used GROUP BY 1),
routes AS (SELECT reaction_id, avg(n - 1) AS routes FROM used JOIN users USING (met) WHERE NOT is_currency GROUP BY 1),
modified AS (SELECT DISTINCT e.dst AS reaction_id FROM edges e JOIN nodes m ON m.node_id = e.src AND m.node_type = 'metabolite' WHERE e.rel = 'modifier'),
p AS (SELECT reaction_id, greatest(0.0, least(1.0, best - least(0.15 * coalesce(routes, 0.0), 0.5) + CASE WHEN f.reaction_id IS NULL THEN 0.0 ELSE 0.05 END)) AS perturbability
  FROM best LEFT JOIN routes USING (reaction_id) LEFT JOIN modified f USING (reaction_id))
SELECT reaction_id, round(perturbability, 6) AS perturbability, round(perturbability * (1 + abs(coalesce(s.score, 0.0))), 6) AS priority FROM p LEFT JOIN scores s USING (reaction_id)
""")
def perturbability(spark, sf):
    g = demo.graph(spark, sf)
    p = sc.perturbability(g, sc.druggability(_drugs(spark, sf)))
    return sc.rounded(sc.actionability(p, sc.score_reactions(g, demo.evidence(spark, sf))).select("reaction_id", "perturbability", "priority"))


def _ranked(n: int) -> str:
    """PageRank of metabolites and their reactions, unrolled to ``n`` rounds, of which the first counts that changes no more than a millionth a node; and what stands on it."""
    sql = """
, pair AS MATERIALIZED (SELECT DISTINCT b.node_id AS met, b.other AS rxn, r.pathways FROM both_ways b JOIN nodes m ON m.node_id = b.node_id AND m.node_type = 'metabolite'
  JOIN nodes r ON r.node_id = b.other AND r.node_type = 'reaction' WHERE b.rel IN ('substrate', 'product', 'modifier')),
b AS MATERIALIZED (SELECT met AS src, rxn AS dst FROM pair UNION ALL SELECT rxn, met FROM pair), dg AS MATERIALIZED (SELECT src, count(*) AS deg FROM b GROUP BY 1),
v AS MATERIALIZED (SELECT node_id FROM nodes WHERE node_type = 'metabolite' UNION SELECT rxn FROM pair), c AS MATERIALIZED (SELECT count(*) AS n FROM v),
r0 AS MATERIALIZED (SELECT node_id, 1.0::DOUBLE / n AS rank, 0.0::DOUBLE AS moved FROM v, c)"""
    for i in range(n):
        sql += f""",
l{i} AS MATERIALIZED (SELECT coalesce(sum(r.rank), 0.0) AS loose FROM r{i} r LEFT JOIN dg ON dg.src = r.node_id WHERE dg.src IS NULL),
x{i} AS MATERIALIZED (SELECT b.dst, sum(r.rank / dg.deg) AS s FROM b JOIN r{i} r ON r.node_id = b.src JOIN dg ON dg.src = b.src GROUP BY 1),
r{i + 1} AS MATERIALIZED (SELECT node_id, rank, abs(rank - old) AS moved FROM (
  SELECT o.node_id, o.rank AS old, 0.15::DOUBLE / c.n + 0.85::DOUBLE * (coalesce(x.s, 0.0) + l.loose / c.n) AS rank FROM r{i} o CROSS JOIN c CROSS JOIN l{i} l LEFT JOIN x{i} x ON x.dst = o.node_id))"""
    every = " UNION ALL ".join(f"SELECT {i} AS i, * FROM r{i}" for i in range(1, n + 1))
    return sql + f""",
rounds AS MATERIALIZED ({every}),
last AS (SELECT min(i) AS i FROM (SELECT i, sum(moved) AS moved FROM rounds GROUP BY i) x, c WHERE x.moved < c.n * 1e-6),
paths AS (SELECT met, count(DISTINCT p) AS n_pathways FROM (SELECT met, unnest(pathways) AS p FROM pair) GROUP BY 1),
many AS (SELECT met, count(*) AS n FROM pair GROUP BY 1)
SELECT m.node_id, coalesce(k.n, 0) AS n_reactions, coalesce(k.n, 0) AS degree, coalesce(p.n_pathways, 0) AS n_pathways, round(r.rank, 9) AS pagerank, round(ln(1 + coalesce(p.n_pathways, 0)) * r.rank, 9) AS branch_score
FROM nodes m JOIN rounds r USING (node_id) JOIN last ON last.i = r.i LEFT JOIN paths p ON p.met = m.node_id LEFT JOIN many k ON k.met = m.node_id WHERE m.node_type = 'metabolite'"""


@query(_ranked(60))
def branch_points(spark, sf):
    return sc.rounded(sc.branch_points(demo.graph(spark, sf)), 9)


@query("""
SELECT node_id, round(sum(effect_size * confidence) / count(*), 6) AS net_effect, count(*) AS n_records
FROM (SELECT 'met:' || l_partkey AS node_id, CAST(round(l_discount * 100) AS BIGINT) - 5 AS effect_size, CAST(round(l_tax * 100) AS BIGINT) AS confidence FROM lineitem) GROUP BY node_id
""")
def evidence_net_effect(spark, sf):
    li = demo.read(spark, sf, "lineitem")
    e = li.select(F.concat(F.lit("met:"), "l_partkey").alias("node_id"), (F.round(F.col("l_discount") * 100).cast("long") - 5).alias("effect_size"), F.round(F.col("l_tax") * 100).cast("long").alias("confidence"))
    return sc.rounded(sc.net_effect(e))
