import itertools

import numpy as np
import pytest

from strandline.llm import quality as q


def test_held_out_rows_are_told_apart(spark):
    d = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in q.op9_quality(spark, d).collect()}
    lab = [(got[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r["doc_id"] in got]
    held = [(r["predicted"], y) for r, y in lab if r["held_out"]]
    assert len(got) == 10_000 and np.mean([p == y for p, y in held]) > 0.97


def brute(e, trans):
    n, total, good = len(e), 0.0, np.zeros(len(e))
    for s in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(e[i] for i in range(n) if s[i]) + sum(trans[a, b] for a, b in zip(s, s[1:])))
        total += w
        good += w * np.array(s)
    return good / total, np.log(total)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    sizes = [3, 1, 6, 1, 4]
    first = np.concatenate([[0], np.cumsum(sizes)])
    e, trans = rng.normal(size=first[-1]), rng.normal(size=(2, 2))
    good, _, z = q.marginals(e, trans, q.Chains(first))
    want = [brute(e[a:b], trans) for a, b in zip(first, first[1:])]
    assert np.allclose(good, np.concatenate([w[0] for w in want])) and z == pytest.approx(sum(w[1] for w in want))


def test_fit_raises_the_likelihood():
    rng = np.random.default_rng(2)
    first = np.arange(0, 301, 5)
    y = np.repeat(rng.integers(0, 2, 60), 5)
    x = np.column_stack([y + rng.normal(size=300), np.ones(300)])
    w, trans = q.fit_field(x, first, y)
    good, _, _ = q.marginals(x @ w, trans, q.Chains(first))
    assert ((good > 0.5) == y).mean() > 0.8 and trans[0, 0] + trans[1, 1] > trans[0, 1] + trans[1, 0]


def test_edges(edge, none, labels):
    scores = edge.select("text", q.quality(edge, labels).alias("s")).collect()
    by = {}
    for r in scores:
        assert 0 <= r["s"] <= 1
        by.setdefault(r["text"] or "", set()).add(r["s"])
    assert all(len(x) == 1 for x in by.values())
    assert q.without_bad(edge, labels).columns == edge.columns
    assert none.select(q.quality(none, labels)).collect() == []
    blank = labels.limit(0)
    assert {r[0] for r in edge.select(q.quality(edge, blank)).collect()} == {0.5}
    assert q.without_bad(edge, blank).count() == edge.count()


def test_constraint_against_enumeration():
    rng = np.random.default_rng(3)
    sizes = [4, 3, 5, 2]
    first = np.concatenate([[0], np.cumsum(sizes)])
    e, trans, length = rng.normal(size=first[-1]), rng.normal(size=(2, 2)), rng.integers(0, 40, first[-1]).astype(float)
    y = np.array([1, 0, 0, 1])
    tilted = q.constrained(e, trans, first, length, y, 0.7)
    for a, b, label in zip(first, first[1:], y):
        good, _ = brute(tilted[a:b], trans)
        before, _ = brute(e[a:b], trans)
        w = (length[a:b] + 1) / (length[a:b] + 1).sum()
        has, had = ((g * w).sum() if label else 1 - (g * w).sum() for g in (good, before))
        assert has == pytest.approx(max(had, 0.7), abs=1e-6)  # no more than it takes
        assert np.allclose((tilted - e)[a:b] / w, (tilted - e)[a] / w[0])


def test_score_against_enumeration(spark):
    import pyarrow as pa

    from strandline.llm import textops as tx

    rng = np.random.default_rng(8)
    texts = ["a line of words\nsecond, line.", "", "### $$$ 12 34\n\nthe end of it\nx | y | z", "one"]
    (_, _, t), = tx.chunks(pa.array(texts))
    f, length, first = q.lines(t)
    x = q.with_neighbours(f, first)
    model = rng.normal(size=x.shape[1]) / 3, rng.normal(size=(2, 2)), (1.3, -0.2)
    want = []
    for a, b in zip(first, first[1:]):
        good, _ = brute((x @ model[0])[a:b], model[1])
        m = min(max((good * (length[a:b] + 1)).sum() / (length[a:b] + 1).sum(), 1e-4), 1 - 1e-4)
        want.append(1 / (1 + np.exp(-(1.3 * np.log(m / (1 - m)) - 0.2))))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    got = [r[1] for r in df.coalesce(1).select("i", q.scorer(model)("text")).orderBy("i").collect()]
    assert np.allclose(got, want)


def test_lines_of_a_document_differ(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    rows = q.labelled_lines(docs, labels).groupBy("doc_id").agg({"label": "avg", "line": "count"}).join(labels, "doc_id").collect()
    bad = [r["avg(label)"] for r in rows if r["quality"] == 0 and r["count(line)"] > 2]
    good = [r["avg(label)"] for r in rows if r["quality"] == 1]
    assert np.mean([0 < x < 1 for x in bad]) > 0.05 and np.mean(bad) < 0.5 and np.mean(good) > 0.8


def test_sample_is_bounded_and_repeats_count_once(spark):
    from strandline.llm.labelled import training_rows

    docs = spark.range(4000).selectExpr("id % 1000 AS doc_id", "string(id % 1000) AS text", "'x' AS y", "'x' AS at")
    labels = spark.range(1000).selectExpr("id AS doc_id", "int(id % 2) AS quality")
    got = [r["doc_id"] for r in training_rows(docs, labels, "quality", 50).collect()]
    assert len(got) == len(set(got)) == 50
    every = [r["doc_id"] for r in training_rows(docs, labels, "quality", 10_000).collect()]
    assert len(every) == len(set(every)) and 700 < len(every) < 800 and set(got) <= set(every)
