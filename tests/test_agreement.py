"""Axes against axes by numpy; the last row of an anchor from a file."""

import numpy as np

from strandline.operators import agreement as ag


def long(spark, m):
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(m) for j, v in enumerate(r)], "axis int, node int, value double")


def test_angles_and_matches(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 9)), rng.normal(size=(3, 9))
    qa, qb = np.linalg.qr(a.T)[0], np.linalg.qr(b.T)[0]
    want = np.sort(np.degrees(np.arccos(np.linalg.svd(qa.T @ qb, compute_uv=False))))
    assert np.allclose(ag.subspace_angles(long(spark, a), long(spark, b)), want)
    cos = np.abs(a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    got = {r["axis"]: (r["match"], r["cosine"]) for r in ag.best_match(long(spark, a), long(spark, b)).collect()}
    assert all(got[i][0] == cos[i].argmax() and np.isclose(got[i][1], cos[i].max()) for i in range(2))


def test_no_axes(spark):
    none = long(spark, [])
    assert ag.subspace_angles(none, none) == [] and ag.best_match(none, none).count() == 0


def test_change_needs_both_times(spark):
    x = spark.createDataFrame([("p", 0, 0, 1.0), ("p", 1, 0, 4.0), ("p", 1, 1, 2.0), ("q", 1, 0, 9.0)], "patient_id string, t int, node int, value double")
    axis = spark.createDataFrame([(0, 2.0), (1, -1.0)], "node int, loading double")
    assert [tuple(r) for r in ag.projected_change(x, axis).collect()] == [("p", 4.0)]


def test_shared_top(spark):
    d = spark.createDataFrame([(1, "a", 3.0), (1, "b", -2.0), (1, "c", 1.0), (2, "b", 5.0), (2, "c", -4.0), (2, "a", 0.5)], "axis int, node string, loading double")
    assert [tuple(r) for r in ag.shared_top(d, 1, 2, 2).collect()] == [("b", 7.0, 3)]
    assert ag.shared_top(d, 1, 2, 2, spark.createDataFrame([("a",)], "node string")).count() == 0


def test_last_row_of_an_anchor(spark, tmp_path):
    (tmp_path / "roi.tsv").write_text("anchor_node\tmodality\troi\nx\tm\t1.5\ny\tt\t2.0\nx\tt\t0.5\n")
    t = ag.roi_table(spark, str(tmp_path / "roi.tsv"))
    assert {r["anchor_node"]: r["roi"] for r in ag.roi_by_anchor(t).collect()} == {"x": 0.5, "y": 2.0}
    assert {r["anchor_node"]: r["roi"] for r in ag.roi_by_anchor(t, "m").collect()} == {"x": 1.5}
