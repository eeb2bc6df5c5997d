"""Queries: iteration over the graph, numerical inference, axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import axes as ax
from ..operators import inference as inf
from ..operators import iterate as it
from ..operators import scoring as sc
from . import demo
from .catalogue import query


def _small(spark, sf, mod: int = 1) -> Graph:
    return demo.graph(spark, sf)


@query("""
, hop1 AS (SELECT DISTINCT d.node_id AS start, b.other AS node_id, 1 AS hop FROM nodes d JOIN both_ways b ON b.node_id = d.node_id WHERE d.node_type = 'disease'),
hop2 AS (SELECT DISTINCT h.start, b.other AS node_id, 2 AS hop FROM hop1 h JOIN both_ways b ON b.node_id = h.node_id),
a AS (SELECT node_id AS start, node_id, 0 AS hop FROM nodes WHERE node_type = 'disease' UNION ALL SELECT * FROM hop1 UNION ALL SELECT * FROM hop2)
SELECT start, node_id, min(hop) AS hop FROM a GROUP BY 1, 2
""")
def khop_2(spark, sf):
    g = demo.graph(spark, sf)
    return it.reach(g.both_ways(), g.of_type("disease").select(F.col("node_id").alias("start")), 2)


_TREE = """
WITH RECURSIVE up AS (
  SELECT p_partkey AS node_id, p_partkey AS anc FROM part
  UNION ALL SELECT node_id, anc // 3 FROM up WHERE anc > 0
)
SELECT anc AS root, count(DISTINCT node_id) AS n_descendants FROM up GROUP BY anc
"""


@query(_TREE, demo=False)
def hierarchy_closure(spark, sf):
    """Ancestors of a hierarchy in which part k lies under k // 3."""
    p = demo.read(spark, sf, "part").select("p_partkey")
    pairs = p.select(F.col("p_partkey").alias("node_id"), F.floor(F.col("p_partkey") / 3).alias("other")).where("node_id > 0")
    r = it.reach(pairs, p.select(F.col("p_partkey").alias("start")))
    return r.groupBy(F.col("node_id").alias("root")).agg(F.count_distinct("start").alias("n_descendants"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS a, (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS b FROM supplier WHERE s_acctbal > 2000),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT s_suppkey AS node_id, s_suppkey AS seen FROM supplier UNION SELECT r.node_id, x.b FROM r JOIN both_ x ON x.a = r.seen)
SELECT node_id, min(seen) AS component FROM r GROUP BY node_id
""", demo=False)
def connected_components(spark, sf):
    s = demo.read(spark, sf, "supplier")
    n = s.agg(F.count("*").alias("n"))
    e = s.where("s_acctbal > 2000").crossJoin(n).select(F.col("s_suppkey").alias("src"), ((F.col("s_suppkey") * 7 + 3) % F.col("n")).alias("dst"))
    return it.components(s.select(F.col("s_suppkey").alias("node_id")), e)


def _rounds(n: int) -> str:
    """PageRank of the gene-disease-reaction bipartite graph, unrolled."""
    sql = """
, v AS (SELECT node_id FROM nodes WHERE node_type IN ('gene', 'disease')), e AS (SELECT src, dst FROM edges WHERE rel = 'disease_gene'),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), dg AS (SELECT src, count(*) AS deg FROM b GROUP BY 1), c AS (SELECT count(*) AS n FROM v),
r0 AS (SELECT node_id, 1.0 / n AS rank FROM v, c)"""
    for i in range(n):
        sql += f""",
r{i + 1} AS (SELECT v.node_id, 0.15 / c.n + 0.85 * (coalesce(x.s, 0.0) + l.loose / c.n) AS rank FROM v CROSS JOIN c CROSS JOIN
  (SELECT coalesce(sum(r.rank), 0.0) AS loose FROM r{i} r LEFT JOIN dg ON dg.src = r.node_id WHERE dg.src IS NULL) l
  LEFT JOIN (SELECT b.dst, sum(r.rank / dg.deg) AS s FROM b JOIN r{i} r ON r.node_id = b.src JOIN dg ON dg.src = b.src GROUP BY 1) x ON x.dst = v.node_id)"""
    return sql + f"\nSELECT node_id, round(rank, 7) AS rank FROM r{n}"


@query(_rounds(6))
def pagerank_fixed(spark, sf):
    g = demo.graph(spark, sf)
    e = g.edges.where("rel = 'disease_gene'").select("src", "dst")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return sc.rounded(it.pagerank(g.of_type("gene", "disease"), both, fixed=6), 7)


@query("""
, s AS (SELECT e1.src AS src, e2.dst AS dst FROM edges e1 JOIN edges e2 ON e2.src = e1.dst AND e2.rel = 'product' WHERE e1.rel = 'substrate')
SELECT DISTINCT src, dst, 'metabolite,reaction' AS via FROM s WHERE src <> dst
""")
def collapse_graph(spark, sf):
    g = demo.graph(spark, sf)
    g = Graph(g.of_type("metabolite", "reaction"), g.edges.where("rel IN ('substrate', 'product')"))
    return it.collapse_graph(g, ["metabolite"], hops=2).select("src", "dst", F.array_join("via", ",").alias("via"))


@query("""
, s AS (SELECT dst AS r, src AS s FROM edges WHERE rel = 'substrate'), p AS (SELECT src AS r, dst AS p FROM edges WHERE rel = 'product'), c AS (SELECT dst AS r, src AS c FROM edges WHERE rel = 'catalysis'),
u AS (SELECT s AS src, p AS dst, 'substrate_product' AS rel FROM s JOIN p USING (r) UNION SELECT c, s, 'gene_substrate' FROM c JOIN s USING (r) UNION SELECT c, p, 'gene_product' FROM c JOIN p USING (r))
SELECT rel, count(*) AS n FROM u WHERE src <> dst GROUP BY rel
""")
def reaction_bypass(spark, sf):
    return it.bypass(demo.graph(spark, sf)).groupBy("rel").agg(F.count("*").alias("n"))


@query("""
, d AS (SELECT node_id, count(*) AS degree FROM both_ways GROUP BY 1),
n AS (SELECT node_id FROM nodes LEFT JOIN d USING (node_id) WHERE node_type IN ('metabolite', 'reaction', 'gene') AND NOT is_currency AND coalesce(degree, 0) <= 60)
SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges WHERE src <> dst AND src IN (SELECT node_id FROM n) AND dst IN (SELECT node_id FROM n)
""")
def biochem_subgraph(spark, sf):
    return it.substrate(demo.graph(spark, sf), ["metabolite", "reaction", "gene"], 60).edges


@query("SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS idx FROM nodes WHERE node_type = 'metabolite'")
def node_index(spark, sf):
    return it.node_index(demo.graph(spark, sf).of_type("metabolite"))


@query("""
, a AS (SELECT node_id FROM nodes WHERE node_type = 'gene'), hop1 AS (SELECT DISTINCT n.node_id AS start, b.other AS x FROM nodes n JOIN both_ways b USING (node_id) WHERE n.node_type = 'disease'),
p1 AS (SELECT start, min([start, x]) AS path FROM hop1 WHERE x IN (SELECT node_id FROM a) GROUP BY 1)
SELECT start, path[2] AS anchor, array_to_string(path, '>') AS path FROM p1
""")
def shortest_to_anchor(spark, sf):
    g = demo.graph(spark, sf)
    return it.shortest_to(g, g.of_type("disease"), g.of_type("gene"), 1).select("start", "anchor", F.array_join("path", ">").alias("path"))


# -- F matrix over the embeddings: patient = vec_id, node = position -------------
def _f(spark, sf):
    return demo.read(spark, sf, "embeddings").select(F.col("vec_id").alias("patient_id"), F.col("label").alias("cohort"), F.posexplode("embedding").alias("node", "f")).withColumn("f", F.col("f").cast("double"))


def _log_pr(f):
    return f.select("node").distinct().select("node", (F.log10(1.0 / (1 + F.col("node")))).alias("log_pr"))


_F = """
WITH f AS (SELECT vec_id AS patient_id, label AS cohort, unnest(range(0, len(embedding))) AS node, CAST(unnest(embedding) AS DOUBLE) AS f FROM embeddings),
pr AS (SELECT DISTINCT node, log10(1.0 / (1 + node)) AS log_pr FROM f),
u AS (SELECT *, f / sqrt(sum(f * f) OVER (PARTITION BY patient_id)) AS x FROM f JOIN pr USING (node)),
b AS (SELECT patient_id, regr_slope(x, log_pr) AS beta, avg(x) AS mx, avg(log_pr) AS mp FROM u GROUP BY 1),
a AS (SELECT u.*, b.beta, (u.x - b.mx) - b.beta * (u.log_pr - b.mp) AS alpha FROM u JOIN b USING (patient_id))
"""


@query(_F + "SELECT patient_id, round(any_value(beta), 6) AS beta, round(sqrt(sum(alpha * alpha)), 6) AS alpha_norm FROM a GROUP BY patient_id", demo=False)
def beta_alpha(spark, sf):
    f = _f(spark, sf)
    return sc.rounded(ax.beta_alpha(f, _log_pr(f)).groupBy("patient_id").agg(F.first("beta").alias("beta"), F.sqrt(F.sum(F.col("alpha") * F.col("alpha"))).alias("alpha_norm")))


@query(_F + """
, m AS (SELECT cohort, node, avg(alpha) AS v FROM a GROUP BY 1, 2), n AS (SELECT cohort, sqrt(sum(v * v)) AS n FROM m GROUP BY 1)
SELECT x.cohort AS a, y.cohort AS b, round(abs(sum(x.v * y.v)) / (any_value(nx.n) * any_value(ny.n)), 6) AS cosine
FROM m x JOIN m y ON x.node = y.node AND x.cohort < y.cohort JOIN n nx ON nx.cohort = x.cohort JOIN n ny ON ny.cohort = y.cohort GROUP BY 1, 2
""", demo=False)
def axis_alignment(spark, sf):
    f = _f(spark, sf)
    m = ax.beta_alpha(f, _log_pr(f)).groupBy(F.col("cohort").alias("axis"), "node").agg(F.avg("alpha").alias("value"))
    return sc.rounded(ax.cosines(m))


@query(_F + """
, t AS (SELECT patient_id, node % 4 AS module, sum(alpha * alpha) AS mass, sum(alpha) AS signed FROM a GROUP BY 1, 2), s AS (SELECT patient_id, sum(mass) AS total FROM t GROUP BY 1)
SELECT patient_id, module, round(mass / total, 6) AS mass, round(signed, 6) AS signed FROM t JOIN s USING (patient_id)
""", demo=False)
def module_mass(spark, sf):
    f = _f(spark, sf)
    a = ax.beta_alpha(f, _log_pr(f)).withColumn("module", F.col("node").cast("long") % 4)
    return sc.rounded(ax.mass_by(a, "module"))


@query(_F + """
, p AS (SELECT node, avg(abs(alpha)) AS peak FROM a GROUP BY 1)
SELECT CAST(node AS INTEGER) AS node, round(peak, 6) AS peak, row_number() OVER (ORDER BY round(peak, 9) DESC, node) AS rank FROM p ORDER BY 3 LIMIT 10
""", demo=False)
def fingerprint_peaks(spark, sf):
    f = _f(spark, sf)
    return sc.rounded(ax.peaks(ax.beta_alpha(f, _log_pr(f)), 10)).withColumn("rank", F.col("rank").cast("long"))


@query("""
WITH e AS (SELECT user_id, ts, event_id, value FROM events),
p AS (SELECT user_id, arg_min(value, (ts, event_id)) AS v0, arg_max(value, (ts, event_id)) AS v1, count(*) AS n FROM e GROUP BY 1)
SELECT user_id, round(v0, 6) AS v0, round(v1, 6) AS v1, round(v1 - v0, 6) AS delta FROM p WHERE n > 1
""", demo=False)
def paired_delta(spark, sf):
    e = demo.read(spark, sf, "events").select(F.col("user_id").alias("patient_id"), F.struct("ts", "event_id").alias("at"), "value")
    return sc.rounded(ax.paired(e).select(F.col("patient_id").alias("user_id"), "v0", "v1", "delta"))


@query(None)
def alpha_pca(spark, sf):
    f = _f(spark, sf)
    return ax.pca(ax.beta_alpha(f, _log_pr(f)).select("patient_id", "node", F.col("alpha").alias("value")), 5)


@query(None)
def signed_basins(spark, sf):
    from ..operators.ranking import signed_basins as basins

    f = _f(spark, sf)
    load = ax.pca_loadings(ax.beta_alpha(f, _log_pr(f)).select("patient_id", "node", F.col("alpha").alias("value")), 3)
    ring = f.select("node").distinct().select(F.col("node").cast("string").alias("src"), ((F.col("node") * 3 + 1) % 64).cast("string").alias("dst"))
    return basins(load.select("pc", F.col("node").cast("string").alias("node_id"), "loading"), ring, 20)


def _substrate(spark, sf):
    return it.substrate(demo.graph(spark, sf), ["metabolite", "gene", "disease", "reaction"], 200)


@query(None)
def map_projection(spark, sf):
    g = _substrate(spark, sf)
    e = demo.evidence(spark, sf).crossJoin(F.broadcast(spark.range(4).select(F.col("id").alias("patient_id"))))
    x = e.select("patient_id", F.lit("m").alias("modality"), "node_id", (F.col("effect_size") * (1 + F.col("patient_id"))).alias("value"))
    return inf.solve_map(g, x, {"m": 1.0}, whole=True)


def _engines(spark, sf):
    """The graph with its relations, hubs included, and the evidence on it."""
    g = it.restricted(demo.graph(spark, sf), ["metabolite", "gene", "disease", "reaction"])
    assay = F.when(F.col("node_id").startswith("met:"), "metabolomics").otherwise("transcriptomics")
    return g, demo.evidence(spark, sf).select(F.lit("s0").alias("sample_id"), assay.alias("assay"), "node_id", "effect_size", "confidence")


@query(None)
def laplacian_posteriors(spark, sf):
    return inf.laplacian(*_engines(spark, sf))


@query(None)
def belief_propagation(spark, sf):
    return inf.belief_propagation(*_engines(spark, sf))
