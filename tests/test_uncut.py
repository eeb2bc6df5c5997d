"""Queries that take hubs, and leading edges, whole."""

import pytest
from pyspark.sql import functions as F

from strandline.graph import Graph
from strandline.operators import enrichment, inference
from strandline.plans import demo, q_infer


@pytest.fixture
def hub(spark, monkeypatch):
    """A metabolite of 230 reactions, with evidence on it alone."""
    nodes = [("met:1", "metabolite", False)] + [(f"rxn:{i}", "reaction", False) for i in range(230)]
    g = Graph(spark.createDataFrame(nodes, "node_id string, node_type string, is_currency boolean"), spark.createDataFrame([("met:1", f"rxn:{i}", "substrate") for i in range(230)], "src string, dst string, rel string"))
    monkeypatch.setattr(demo, "graph", lambda *_: g)
    monkeypatch.setattr(demo, "evidence", lambda *_: spark.createDataFrame([("met:1", 3.0, 1.0)], "node_id string, effect_size double, confidence double"))


@pytest.mark.parametrize("limit", [inference.MOST_EDGES, 3])
@pytest.mark.parametrize("name,of", [("belief_propagation", "p_down - p_up"), ("laplacian_posteriors", "score")])
def test_hubs_take_part(spark, hub, monkeypatch, limit, name, of):
    monkeypatch.setattr(inference, "MOST_EDGES", limit)
    got = {r["node_id"]: r["x"] for r in getattr(q_infer, name)(spark, "").select("node_id", F.expr(of).alias("x")).collect()}
    assert len(got) == 231 and min(abs(x) for x in got.values()) > 0.01  # the hub is there, and reaches them all


def test_leading_edges_are_whole(spark):
    r = spark.range(100).select(F.format_string("n%02d", "id").alias("node_id"), (100 - F.col("id")).cast("double").alias("score"))
    m = r.where("score > 60").select(F.lit("s").alias("pathway_id"), "node_id")
    got = enrichment.preranked(m, r).first()
    assert got["leading_edge"] == ",".join(f"n{i:02}" for i in range(40))


def test_members_are_laid_down_as_places(spark, monkeypatch):
    kept, laid = [], enrichment.laid
    monkeypatch.setattr(enrichment, "laid", lambda d: (kept.append(d.columns), laid(d))[1])
    r = spark.range(9).select(F.format_string("n%02d", "id").alias("node_id"), (100 - F.col("id")).cast("double").alias("score"))
    got = enrichment.preranked(r.select(F.lit("s").alias("pathway_id"), "node_id").limit(4), r).first()
    assert got["n_hits"] == 4 and kept and all("node_id" not in c for c in kept)
