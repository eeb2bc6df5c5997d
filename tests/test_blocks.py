"""Blocks that send one another what changed: what stays on disk, sets in turn, forests of forests, long chains."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.graph import Graph
from strandline.operators import bridging as br
from strandline.operators import iterate, tiles

PAIR, TERM = "node_id string, other string", "set string, node_id string"


@pytest.fixture
def ring(spark):
    edges = [(f"n{i:02}", f"n{(i * k + 1) % 40:02}") for i in range(40) for k in (1, 3)]
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(40)], "node_id string")
    return Graph(nodes, spark.createDataFrame(edges, "src string, dst string").withColumn("rel", F.lit("x")))


def test_rounds_leave_one_state(spark, ring):
    """Before, each round's checkpoint stayed."""
    folder = iterate._folder(spark).removeprefix("file:")
    count = lambda: len(glob.glob(f"{folder}/rdd-*"))
    t = tiles.tiled(ring)
    width = t.width
    start = tiles.stated(t, lambda b, x: {"diag": np.full((1, 1), 4.0), "root": np.ones((width, 1)), "b": np.eye(width)[:, :1] * (b == 0)})
    before = count()
    x, fine = tiles.solve(t, start, 1, 1e-12, 50, 0.2)
    assert fine.all() and count() <= before + 1


def test_values_go_where_they_are_needed(spark, ring):
    """A value is sent once to each block that has a neighbour, whatever their number."""
    t = tiles.tiled(ring)
    near = {}
    for r in ring.edges.collect():
        for a, b in ((r["src"], r["dst"]), (r["dst"], r["src"])):
            near.setdefault(a, set()).add(int(b[1:]) % t.blocks)
    state = tiles.stated(t, lambda b, x: None)
    got = tiles.sent(t, state, lambda s, ids: len(ids)).map(lambda m: m[1][1][1]).sum()
    assert got == sum(map(len, near.values())) < 40 * t.blocks


def test_forests_of_forests():
    rng = random.Random(5)
    links = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(400)})
    a, b = (np.array(x) for x in zip(*links))
    w = np.array([rng.randrange(1, 6) for _ in links])
    part, want = list(range(60)), set()
    for k in sorted(range(len(links)), key=lambda k: (w[k], *links[k])):
        top = list(links[k])
        for i, x in enumerate(top):
            while part[x] != x:
                x = part[x]
            top[i] = x
        if top[0] != top[1]:
            part[top[0]] = top[1]
            want.add(k)
    assert set(br.forest(a, b, w)) == want
    halves = [np.arange(len(a))[i::3] for i in range(3)]
    some = np.concatenate([h[br.forest(a[h], b[h], w[h])] for h in halves])
    assert {int(some[i]) for i in br.forest(a[some], b[some], w[some])} == want


def test_sets_in_turn_and_small_tasks(spark, monkeypatch):
    rng = random.Random(7)
    edges = sorted({tuple(sorted(rng.sample([f"n{i:02}" for i in range(50)], 2))) for _ in range(90)})
    pairs = spark.createDataFrame(sorted(edges + [(b, a) for a, b in edges]), PAIR)
    t = spark.createDataFrame([(f"s{k}", f"n{i:02}") for k in range(3) for i in rng.sample(range(50), 9)], TERM)
    rows = lambda d: sorted(map(tuple, d.collect()), key=repr)
    want = rows(br.distance_cells(pairs, t)), rows(br.spanning(pairs, t))
    monkeypatch.setattr(tiles, "CELLS", 1), monkeypatch.setattr(br, "LINKS", 4), monkeypatch.setattr(br, "NAMES", 0)
    assert (rows(br.distance_cells(pairs, t)), rows(br.spanning(pairs, t))) == want
    assert sorted({r[0] for r in want[1]}) == ["s0", "s1", "s2"]


def test_long_chains_are_one_component(spark, monkeypatch):
    monkeypatch.setattr(br, "ROUNDS", 2)
    edges = [(f"n{i:02}", f"n{i + 1:02}") for i in range(20)] + [("z1", "z2")]
    pairs = spark.createDataFrame(edges + [(b, a) for a, b in edges], PAIR)
    t = spark.createDataFrame([("s", "n00"), ("s", "n20"), ("s", "z1"), ("s", "nowhere")], TERM)
    got = br.in_main_component(pairs.select("node_id").distinct(), pairs, t)
    assert sorted(map(tuple, got.collect())) == [("s", "n00"), ("s", "n20")]


def test_ranks_leave_one_state(spark):
    """Before, each round's checkpoint stayed; edges of one direction, a node that leads nowhere, nodes apart."""
    folder = iterate._folder(spark).removeprefix("file:")
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("d", "a"), ("a", "e"), ("a", "b")]
    nodes = [(x,) for x in "abcdez"]
    before = len(glob.glob(f"{folder}/rdd-*"))
    got = {r["node_id"]: r["rank"] for r in iterate.pagerank(spark.createDataFrame(nodes, "node_id string"), spark.createDataFrame(e, "src string, dst string"), fixed=9).collect()}
    m, ids = np.zeros((6, 6)), "abcdez"
    for a, b in set(e):
        m[ids.index(b), ids.index(a)] = 1
    out, rank = m.sum(0), np.full(6, 1 / 6)
    for _ in range(9):
        rank = 0.15 / 6 + 0.85 * (m @ (rank / np.maximum(out, 1)) + rank[out == 0].sum() / 6)
    assert np.allclose([got[x] for x in ids], rank, atol=1e-15) and len(glob.glob(f"{folder}/rdd-*")) <= before + 4


def test_correlations_in_turns(spark):
    from strandline.operators import models

    rng = np.random.default_rng(3)
    x = spark.createDataFrame([(s, f"f{f:02}", float(rng.integers(0, 4) + (f % 3) * s)) for s in range(9) for f in range(12) if rng.random() < 0.7], "sample_id long, feature_id string, value double")
    rows = lambda d: sorted((a, b, round(r, 12)) for a, b, r in d.collect())
    want = rows(models.correlation_edges(x))
    assert rows(models.correlation_edges(x, pairs=8, turn=60)) == want and len(want) > 5
