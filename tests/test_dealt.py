"""Tasks stay as they are while tables grow, and what is read once is read once."""

import numpy as np
from pyspark.sql import functions as F

from strandline.graph import Graph
from strandline.operators import iterate, models, scoring
from strandline.plans import q_stats


def test_measurements_are_dealt_by_the_size_of_the_input(spark, sf, monkeypatch):
    monkeypatch.setattr(iterate, "PORTION", 100)
    n = -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 100)
    for d in (q_stats.measure(spark, sf, "feature_id"), q_stats.labelled(spark, sf)):
        assert d.rdd.getNumPartitions() == n > 4


def test_gates_of_two_kinds_in_one_pass(spark):
    e = spark.createDataFrame([("g1", "r", "catalysis"), ("g2", "r", "catalysis")], "src string, dst string, rel string")
    ev = spark.createDataFrame([("g1", 1.0), ("g2", -0.25)], "node_id string, effect_size double")
    r = scoring.enzyme_gate(Graph(None, e), ev, also=("max", "mean")).first()
    assert (r["reaction_id"], r["max"]) == ("r", 1.0) and abs(r["gate"] - 0.65) < 1e-12 and abs(r["mean"] - 0.65**0.5) < 1e-12


def test_details_are_collected_once(spark, sf):
    from strandline.plans import demo

    d = scoring.score_reactions(demo.graph(spark, sf), demo.evidence(spark, sf), detail=True)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1
    for c in ("supporting_metabolites", "supporting_genes", "contradictory_metabolites"):
        assert d.where(F.size(c) > 1).count() or c == "contradictory_metabolites"
        assert d.where(F.col(c) != F.array_sort(c)).isEmpty()


def test_intervals_read_their_rows_once(spark):
    rng = np.random.default_rng(0)
    d = [(f, float(rng.integers(9)), bool(rng.random() > 0.6)) for f in range(5) for _ in range(40)]
    d += [(5, 1.0, True), (5, 2.0, True), (6, 1.0, False), (7, 1.0, True), (7, 1.0, False), (7, None, True), (8, 3.0, None), (None, 1.0, True), (None, 2.0, False)]
    got = models.delong(spark.createDataFrame(d, "f long, v double, y boolean").repartition(3, "f"), ["f"], "v", "y")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1
    got = {r["f"]: (r["auc"], r["se"]) for r in got.collect()}
    assert got.keys() == {0, 1, 2, 3, 4, 7, None}  # the others have one class; a null is a key, as in SQL
    for f in got:
        own = [(v, y) for g, v, y in d if g == f and v is not None]
        a, b = (np.array([v for v, y in own if y == k]) for k in (True, False))
        over = (a[:, None] > b) + (a[:, None] == b) / 2
        var = lambda x: x.var(ddof=1) if len(x) > 1 else 0.0
        assert np.allclose(got[f], (over.mean(), np.sqrt(var(over.mean(1)) / len(a) + var(over.mean(0)) / len(b))))
