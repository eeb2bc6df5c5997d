import numpy as np
import pytest

from strandline.operators import survival as sv

ROWS = "sample_id long, fold int, time double, event boolean, x array<double>"


def plain_fit(x, time, event, penalty=0.0):
    """Newton's method on the Breslow likelihood, risk set by risk set."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd > 1e-12, sd, 1.0)
    z, n, beta = (x - mean) / sd, len(x), np.zeros(x.shape[1])
    for _ in range(60):
        w, g, h = np.exp(z @ beta), np.zeros(len(beta)), np.zeros((len(beta),) * 2)
        for i in np.flatnonzero(event):
            r = time >= time[i]
            s0, s1 = w[r].sum(), w[r] @ z[r]
            g += z[i] - s1 / s0
            h += (z[r] * w[r, None]).T @ z[r] / s0 - np.outer(s1, s1) / s0**2
        step = np.linalg.lstsq(h + penalty * n * np.eye(len(beta)), g - penalty * n * beta, rcond=1e-12)[0]
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    return beta / sd


def cohort(seed, n=160, ties=None, hot=0.0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n) * 3 + 5, rng.integers(0, 2, n), rng.normal(size=n)])
    time = rng.exponential(np.exp(-(0.3 * x[:, 0] - 0.8 * x[:, 1])))
    time = np.ceil(time / time.max() * ties) if ties else time
    time[rng.random(n) < hot] = np.median(time)
    return x, time, rng.random(n) < 0.7, rng.integers(0, 3, n)


def frame(spark, x, time, event, fold):
    rows = [(i, int(fold[i]), float(time[i]), bool(event[i]), [float(v) for v in x[i]]) for i in range(len(x))]
    return spark.createDataFrame(rows, ROWS).repartition(3)


@pytest.mark.parametrize("ties,hot,ranges,penalty", [(None, 0.0, 8, 0.0), (12, 0.0, 16, 0.01), (None, 0.4, 8, 0.01)])
def test_all_folds_against_numpy(spark, ties, hot, ranges, penalty):
    x, time, event, fold = cohort(4, ties=ties, hot=hot)
    got = sv.fit(frame(spark, x, time, event, fold), penalty, ranges).collect()
    for f in (0, 1, 2, sv.WHOLE):
        train = fold != f
        want = plain_fit(x[train], time[train], event[train], penalty)
        mine = [r["coef"] for r in sorted((r for r in got if r["fold"] == f), key=lambda r: r["feature"])]
        assert np.allclose(mine, want, atol=1e-6), f


def test_a_time_of_many_rows_is_split(spark):
    x, time, event, fold = cohort(5, hot=0.5)
    parts = sv._ranged(frame(spark, x, time, event, fold), 8).groupBy("span", "part").count().collect()
    assert max(r["count"] for r in parts) < 0.3 * len(x)


def test_score_test_is_the_log_rank_test(spark):
    x, time, event, fold = cohort(6, ties=15)
    r = sv.score_test(frame(spark, x[:, 1:2], time, event, fold), 8).first()
    u = v = 0.0
    for t in np.unique(time[event]):
        risk, d = time >= t, (time == t) & event
        share = x[risk, 1].mean()
        u += x[d, 1].sum() - d.sum() * share
        v += d.sum() * share * (1 - share)
    assert np.allclose([r["u"], r["v"], r["chi2"]], [u, v, u * u / v])


def test_held_out_concordance(spark):
    x, time, event, fold = cohort(7)
    got = {r["fold"]: r["c_index"] for r in sv.cross_validated(frame(spark, x, time, event, fold), ranges=8).collect()}
    for f in range(3):
        test = np.flatnonzero(fold == f)
        risk = x[test] @ plain_fit(x[fold != f], time[fold != f], event[fold != f], 0.01)
        good = pairs = 0.0
        for a, i in enumerate(test):
            for b, j in enumerate(test):
                if event[i] and time[i] < time[j]:
                    pairs += 1
                    good += (risk[a] > risk[b]) + 0.5 * (risk[a] == risk[b])
        assert np.isclose(got[f], good / pairs)
    assert min(got.values()) > 0.6


def test_rows_that_take_no_part(spark):
    x, time, event, fold = cohort(8, n=60)
    d = frame(spark, x, time, event, fold)
    bad = spark.createDataFrame([(900, 0, None, True, [1.0, 2.0, 3.0]), (901, 1, 1.0, None, [1.0, 2.0, 3.0]), (902, 1, 1.0, True, [1.0, None, 3.0]), (903, 1, 1.0, True, None)], ROWS)
    key = lambda r: (r["fold"], r["feature"])
    a, b = (sorted(sv.fit(x, 0.01, 4).collect(), key=key) for x in (d, d.unionByName(bad)))
    assert np.allclose([r["coef"] for r in a], [r["coef"] for r in b])
    assert sv.fit(d.where("NOT event")).collect() == [] and sv.fit(d.limit(0)).collect() == [] and sv.score_test(d.limit(0)).collect() == []
