"""Work that must not grow faster than its input, whatever the groups are."""

import numpy as np
import pytest

from strandline.operators import lowrank, models


@pytest.mark.parametrize("pairs", [models.PAIRS, 8])
def test_correlations_in_small_portions(spark, pairs):
    rng = np.random.default_rng(3)
    m = {(s, f"f{f:02}"): float(rng.integers(0, 4) + (f % 3) * s) for s in range(9) for f in range(12) if rng.random() < 0.7}
    x = spark.createDataFrame([(s, f, v) for (s, f), v in m.items()], "sample_id long, feature_id string, value double")
    ranks = {}
    for f in {k[1] for k in m}:
        own = {s: v for (s, g), v in m.items() if g == f}
        for s, v in own.items():
            ranks[s, f] = sum(u < v for u in own.values()) + (sum(u == v for u in own.values()) + 1) / 2
    want = {}
    for a in sorted({k[1] for k in m}):
        for b in sorted({k[1] for k in m}):
            both = [s for s in range(9) if (s, a) in ranks and (s, b) in ranks]
            u, v = (np.array([ranks[s, f] for s in both]) for f in (a, b))
            if a < b and len(both) > 2 and u.std() and v.std() and abs(rho := np.corrcoef(u, v)[0, 1]) >= 0.5 - 1e-12:
                want[a, b] = rho
    e = models.correlation_edges(x, pairs=pairs)
    got = {(r["a"], r["b"]): r["rho"] for r in e.collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want) and len(want) > 5


def test_no_common_samples(spark):
    x = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "sample_id long, feature_id string, value double")
    assert models.correlation_edges(x).collect() == [] and models.correlation_edges(x.limit(0)).collect() == []


def test_few_nodes_need_no_rounds(spark, monkeypatch):
    """Sketches of up to WHOLE nodes leave nothing out."""
    rng = np.random.default_rng(2)
    m = rng.normal(size=(80, 30))
    x = spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "patient_id long, node long, value double")
    calls, scores = [], lowrank._scores
    monkeypatch.setattr(lowrank, "_scores", lambda *a: calls.append(1) or scores(*a))
    _, _, share = lowrank.axes(x, 3)
    s = np.linalg.svd(m - m.mean(0), compute_uv=False) ** 2
    assert len(calls) == 1 and np.allclose(share, (s / s.sum())[:3])
