"""Queries: facades, paired measurements, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..graph import upsert
from ..operators import axes as ax
from ..operators import scoring as sc
from ..operators import stats as st
from ..operators.iterate import cut
from . import demo, score
from .catalogue import query
from .q_map import _chem
from .q_stats import MEASURE, cases, measure


@query("""
, lab AS (SELECT 'met:' || l_partkey AS node_id, CAST(l_partkey AS BIGINT) AS k, sum(CAST(round(l_discount * 100) AS BIGINT)) % 11 - 5 AS effect_size FROM lineitem GROUP BY 1, 2),
ev AS (SELECT node_id, CAST(effect_size AS DOUBLE) AS e FROM lab),
c AS (
  SELECT e.dst AS r, -v.e / sqrt(d.degree) AS c FROM edges e JOIN nodes m ON m.node_id = e.src AND NOT m.is_currency JOIN rdegree d ON d.node_id = e.src JOIN ev v ON v.node_id = e.src WHERE e.rel = 'substrate'
  UNION ALL SELECT e.src, v.e / sqrt(d.degree) FROM edges e JOIN nodes m ON m.node_id = e.dst AND NOT m.is_currency JOIN rdegree d ON d.node_id = e.dst JOIN ev v ON v.node_id = e.dst WHERE e.rel = 'product')
SELECT c.r AS reaction_id, round(sum(CASE WHEN n.reversible THEN abs(c.c) ELSE c.c END) / sqrt(count(*)), 6) AS score, count(*) AS evidence_count FROM c JOIN nodes n ON n.node_id = c.r GROUP BY 1
""")
def score_from_tables(spark, sf):
    t = demo.read(spark, sf, "lineitem").groupBy(F.concat(F.lit("chebi:"), "l_partkey").alias("Metabolite")).agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")) % 11 - 5).alias("log2FC"))
    s = score.score_tables(_chem(spark, sf), {"metabolomics": t})
    return sc.rounded(s.select("reaction_id", "score", "evidence_count"))


@query("""
, d AS (SELECT node_id AS start FROM nodes WHERE node_type = 'disease'), h1 AS (SELECT DISTINCT b.other AS x FROM d JOIN both_ways b ON b.node_id = d.start), h2 AS (SELECT DISTINCT b.other AS x FROM h1 JOIN both_ways b ON b.node_id = h1.x),
near AS (SELECT start AS x FROM d UNION SELECT x FROM h1 UNION SELECT x FROM h2),
direct AS (SELECT node_id FROM nodes WHERE node_type = 'metabolite' AND node_id IN (SELECT x FROM near)),
rx AS (SELECT node_id, unnest(pathways) AS p FROM nodes WHERE node_type = 'reaction'), pa AS (SELECT DISTINCT p FROM rx WHERE node_id IN (SELECT x FROM near)),
ex AS (SELECT DISTINCT b.other AS node_id FROM rx JOIN pa USING (p) JOIN both_ways b ON b.node_id = rx.node_id JOIN nodes m ON m.node_id = b.other AND m.node_type = 'metabolite')
SELECT coalesce(direct.node_id, ex.node_id) AS node_id, concat_ws('+', CASE WHEN direct.node_id IS NOT NULL THEN 'direct' END, CASE WHEN ex.node_id IS NOT NULL THEN 'pathway_expand' END) AS provenance
FROM direct FULL JOIN ex ON direct.node_id = ex.node_id
""")
def reach_from_disease(spark, sf):
    g = demo.graph(spark, sf)
    return score.metabolites_for_diseases(g, g.of_type("disease"))


@query("""
WITH raw AS (SELECT l_orderkey AS src, l_partkey AS dst, l_returnflag AS role, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS weight, l_suppkey * 1000000 + CAST(l_extendedprice AS BIGINT) AS seq FROM lineitem)
SELECT src, dst, arg_max(role, seq) AS role, arg_max(weight, seq) FILTER (WHERE weight IS NOT NULL) AS weight FROM raw GROUP BY 1, 2
""", demo=False)
def edge_upsert_last_wins(spark, sf):
    seq = F.col("l_suppkey") * 1_000_000 + F.round("l_extendedprice").cast("long")
    new = demo.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("role"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).alias("weight"), seq.alias("load_seq"))
    return upsert(new.drop("load_seq").limit(0), new, ["src", "dst"])


@query("""
, p AS (SELECT reaction_id, 1 / (1 + exp(-score)) AS up FROM scores), t AS (SELECT node_id FROM nodes WHERE node_type = 'reaction' AND list_contains(pathways, '2-HIGH')),
o AS (SELECT avg(abs(2 * up - 1)) AS observed FROM p WHERE reaction_id IN (SELECT node_id FROM t)),
n AS (SELECT k AS perm, avg(abs(2 * up - 1)) AS m FROM p, range(1, 8) r(k) WHERE 'rxn:' || CAST((CAST(split_part(reaction_id, ':', 2) AS BIGINT) + k * 101) % (SELECT count(*) FROM orders) AS VARCHAR) IN (SELECT node_id FROM t) GROUP BY 1)
SELECT round(any_value(observed), 6) AS observed, round(avg(m), 6) AS null_mean, round(stddev_samp(m), 6) AS null_sd, round((any_value(observed) - avg(m)) / stddev_samp(m), 5) AS z FROM n, o
""")
def targeted_sigma(spark, sf):
    g = demo.graph(spark, sf)
    s = sc.score_reactions(g, demo.evidence(spark, sf))
    up = 1 / (1 + F.exp(-F.col("score")))
    p = cut(s.select("reaction_id", up.alias("p_up"), (1 - up).alias("p_down")))  # for what is observed and for what is permuted
    n = demo.read(spark, sf, "orders").agg(F.count("*").alias("n"))
    k = F.split_part("reaction_id", F.lit(":"), F.lit(2)).cast("long")
    perm = p.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(7)))).crossJoin(n).withColumn("reaction_id", F.concat(F.lit("rxn:"), (k + F.col("perm") * 101) % F.col("n")))
    z = cut(sc.targeted_sigma(p, perm.select("perm", "reaction_id", "p_up", "p_down"), sc.reactions_in_pathways(g, ["2-HIGH"]).select(F.col("node_id").alias("reaction_id"))))
    return sc.rounded(z.select("observed", "null_mean", "null_sd")).crossJoin(z.select((F.round("z", 5) + F.lit(0.0)).alias("z")))


@query(f"""WITH {MEASURE.strip()},
l AS (SELECT sample_id, feature_id % 3 AS assay, feature_id, value / sqrt(sum(value * value) OVER (PARTITION BY sample_id, feature_id % 3)) AS unit FROM measure)
SELECT sample_id, feature_id, round(unit, 6) AS unit FROM l
""", demo=False)
def l2_normalise_per_omic(spark, sf):
    from pyspark.sql import Window

    m = measure(spark, sf).withColumn("assay", F.col("feature_id") % 3)
    w = Window.partitionBy("sample_id", "assay")
    return sc.rounded(m.select("sample_id", "feature_id", (F.col("value") / F.sqrt(F.sum(F.col("value") * F.col("value")).over(w))).alias("unit")))


@query("""
WITH f AS (SELECT vec_id AS patient_id, label, unnest(range(0, len(embedding))) AS axis, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
r AS (SELECT label % 3 AS meta, axis, label >= 5 AS y, rank() OVER (PARTITION BY label % 3, axis ORDER BY v) + (count(*) OVER (PARTITION BY label % 3, axis, v) - 1) / 2.0 AS r FROM f),
a AS (SELECT meta, axis, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n, sum(r) FILTER (WHERE y) AS rs FROM r GROUP BY 1, 2),
s AS (SELECT meta, axis, 2 * abs((rs - p * (p + 1) / 2.0) / (p * n) - 0.5) AS strength FROM a WHERE p > 0 AND n > 0)
SELECT meta, CAST(arg_min(axis, (-round(strength, 9), axis)) AS INTEGER) AS axis, round(max(strength), 6) AS strength FROM s GROUP BY meta
""", demo=False)
def best_axis(spark, sf):
    e = demo.read(spark, sf, "embeddings").select((F.col("label") % 3).alias("meta"), (F.col("label") >= 5).alias("y"), F.posexplode("embedding").alias("axis", "v")).withColumn("v", F.col("v").cast("double"))
    return sc.rounded(score.best_axes(st.strength(e, ["meta", "axis"], "v", "y", True), ["meta"]))


@query("""
WITH e AS (SELECT user_id, event_type, ts, event_id, value FROM events),
p AS (SELECT user_id, event_type, arg_min(value, (ts, event_id)) AS v0, arg_max(value, (ts, event_id)) AS v1, count(*) AS n FROM e GROUP BY 1, 2),
t AS (SELECT user_id, CAST(floor(v0 / 25) AS INTEGER) AS c0, CAST(floor(v1 / 25) AS INTEGER) AS c1 FROM p WHERE n > 1)
SELECT c0, c1, count(*) AS n FROM t GROUP BY 1, 2
""", demo=False)
def transition_matrix(spark, sf):
    e = demo.read(spark, sf, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("patient_id"), F.struct("ts", "event_id").alias("at"), "value")
    p = ax.paired(e)
    return p.groupBy(F.floor(F.col("v0") / 25).cast("int").alias("c0"), F.floor(F.col("v1") / 25).cast("int").alias("c1")).agg(F.count("*").alias("n"))


@query(None)
def sample_posteriors(spark, sf):
    """A sample is a nation: the mean over all its customers."""
    m = measure(spark, sf).join(cases(spark, sf), "sample_id").groupBy(F.col("cohort").alias("sample_id"), "feature_id").agg(F.avg("value").alias("value"))
    v = m.select("sample_id", "feature_id", (F.col("value") / 1e6).alias("value"), F.concat(F.lit("met:"), "feature_id").alias("node_id"), F.lit("metabolomics").alias("assay"))
    return score.score_samples(demo.graph(spark, sf), v, ["metabolite", "reaction", "gene"], hub_cap=200)
