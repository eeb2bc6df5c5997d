import numpy as np
import pytest

from strandline.operators import axes, lowrank

LONG = "patient_id long, node long, value double"


def long(m):
    return [(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r) if v]


def by_numpy(m, k):
    c = m - m.mean(0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    return s[:k] ** 2 / (s**2).sum(), v[:k], c


def test_sketches_merge_to_the_sketch_of_all():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(90, 20)) + np.arange(20)
    parts = [lowrank.of_rows(m[a:b], 20) for a, b in ((0, 1), (1, 40), (40, 90))]
    left = lowrank.merged([lowrank.merged(parts[:2], 20), parts[2]], 20)
    share, v, _ = by_numpy(m, 20)
    s = np.linalg.svd(left.axes, compute_uv=False) ** 2
    assert left.n == 90 and np.allclose(left.mean, m.mean(0)) and np.allclose(s / s.sum(), share) and left.lost < 1e-9
    cut = lowrank.merged(parts, 3)
    assert cut.axes.shape == (3, 20) and cut.lost > 0


@pytest.mark.parametrize("n,width,spare", [(200, 60, 2), (30, 80, 8), (40, 5, 8)])
def test_against_numpy(spark, n, width, spare):
    rng = np.random.default_rng(n)
    m = np.round(rng.normal(size=(n, width)) @ np.diag(3 * 0.8 ** np.arange(width) + 0.1), 3)
    m[rng.random(m.shape) < 0.2] = 0
    x = spark.createDataFrame(long(m), LONG).repartition(7)
    load, means, share = lowrank.axes(x, 3, spare)
    want, v, _ = by_numpy(m, 3)
    assert np.allclose(share, want, rtol=1e-8)
    got = np.zeros((3, width))
    for r in load.collect():
        got[r["pc"] - 1, r["node"]] = r["loading"]
    assert np.allclose(np.abs((got * v).sum(1)), 1, atol=1e-6)
    assert all(g[np.abs(g).argmax()] > 0 for g in got)
    assert np.allclose([r["mean"] for r in means.orderBy("node").collect()], m.mean(0))


def test_scores_of_patients_without_some_nodes(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(25, 6)) + 2
    m[rng.random(m.shape) < 0.4] = 0
    m[0, 0] = m[-1, -1] = 1.0
    x = spark.createDataFrame(long(m), LONG)
    share, v, c = by_numpy(m, 2)
    got = {(r["patient_id"], r["pc"]): (r["score"], r["explained"]) for r in axes.pca(x, 2).collect()}
    for j in range(2):
        s = c @ (v[j] * np.sign(v[j][np.abs(v[j]).argmax()]))
        for i in {r[0] for r in long(m)}:
            assert np.isclose(got[i, j + 1][0], s[i]) and np.isclose(got[i, j + 1][1], share[j])


def test_more_nodes_than_a_matrix_would_take(spark):
    """The former limit was 4,096 nodes."""
    x = spark.range(0, 40).selectExpr("id AS patient_id", "explode(array(id * 500, id * 500 + 1)) AS node").selectExpr("patient_id", "node", "CAST(1 + patient_id % 3 + node % 2 AS DOUBLE) AS value")
    load = axes.pca_loadings(x, 2)
    assert load.count() == 2 * 80
    assert [r["pc"] for r in load.select("pc").distinct().orderBy("pc").collect()] == [1, 2]


def test_nothing_to_decompose(spark):
    e = spark.createDataFrame([], LONG)
    assert axes.pca(e, 2).collect() == [] and axes.pca_loadings(e, 2).collect() == []
    one = spark.createDataFrame([(1, 0, 2.0), (1, 1, 3.0)], LONG)
    assert axes.pca(one, 2).collect() == []
