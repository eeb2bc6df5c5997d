from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import mixing

SOURCES = "source_key string, late boolean, weight double, blocks long"


def ideal(share, blocks, t):
    """What each source has by time ``t`` when all that last are read at once: exact, a step to each end."""
    got, left = dict.fromkeys(share, Fraction(0)), Fraction(t)
    while left:
        live = [k for k in share if got[k] < blocks[k]]
        if not live:
            break
        rate = sum(share[k] for k in live)
        step = min([left] + [(blocks[k] - got[k]) * rate / share[k] for k in live])
        for k in live:
            got[k] += step * share[k] / rate
        left -= step
    return got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 30)), min_size=1, max_size=8))
def test_windows_and_deviation(sources):
    share, blocks = np.array([s for s, _ in sources]), np.array([min(s, b) for s, b in sources])
    source, release, deadline = mixing.windows(share, blocks)
    slot = mixing.first_due(release, deadline)
    total = int(blocks.sum())
    assert sorted(slot.tolist()) == list(range(total)) and (release <= slot).all() and (slot < deadline).all()
    for t in range(total + 1):
        want = ideal(dict(enumerate(share.tolist())), dict(enumerate(blocks.tolist())), t)
        for k in range(len(share)):
            assert abs(int(((source == k) & (slot < t)).sum()) - want[k]) < 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 30)), min_size=1, max_size=8))
def test_states_are_those_of_the_one_schedule(sources):
    weight, blocks = np.array([w for w, _ in sources]), np.array([b for _, b in sources])
    source, release, deadline = mixing.windows(weight, blocks)
    slot = mixing.first_due(release, deadline)
    i = mixing.Ideal(weight, blocks)
    for t in range(i.total + 1):
        assert i.done_by(t).tolist() == np.bincount(source[slot < t], minlength=len(blocks)).tolist()


def _deviation(rows, weight, blocks):
    """The largest distance from the target weights over all slots, while all sources last."""
    at = {k: n for n, k in enumerate(weight)}
    who = np.empty(len(rows), np.int64)
    for r in rows:
        who[r["slot"]] = at[r[mixing._KEY]]
    w, b = np.array([weight[k] for k in at], float), np.array([blocks[k] for k in at])
    t = int(min(b / w) * w.sum())
    worst = 0.0
    for k in range(len(w)):
        got = np.append(0, np.cumsum(who[:t] == k))
        worst = max(worst, np.abs(got - np.arange(t + 1) * w[k] / w.sum()).max())
    return worst


@pytest.mark.parametrize("period", [3, 13, 64])
def test_target_weights_over_many_rounds(spark, period):
    """Weights that no period holds in whole shares: the distance doesn't grow from round to round."""
    weight, blocks = {"a": 1.0, "b": 2.0, "c": 0.37, "d": 2**0.5}, {"a": 500, "b": 1000, "c": 200, "d": 900}
    rows = mixing.schedule(spark.createDataFrame([(k, False, weight[k], blocks[k]) for k in weight], SOURCES), period).collect()
    assert sorted(r["slot"] for r in rows) == list(range(2600)) and len(rows) == 2600
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    assert _deviation(rows, weight, blocks) < 1


def test_one_large_source_and_many_small_ones(spark):
    weight = {"big": 1e6} | {f"s{i:05}": 1.0 for i in range(20_000)}
    blocks = {k: 60_000 if k == "big" else 3 for k in weight}
    rows = mixing.schedule(spark.createDataFrame([(k, False, weight[k], blocks[k]) for k in weight], SOURCES)).collect()
    assert sorted(r["slot"] for r in rows) == list(range(120_000))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    got = np.zeros(120_000, bool)
    got[[r["slot"] for r in rows if r[mixing._KEY] == "big"]] = True
    assert np.abs(np.cumsum(got)[:60_000] - np.arange(1, 60_001) / 1.02).max() < 1


def test_rounds_keep_the_ideal_over_all(spark):
    """Many rounds, sources that end at different times, and late ones: within a block of the ideal at every slot."""
    sources = [("a", False, 8.0, 100), ("b", False, 4.0, 7), ("c", False, 1.0, 30), ("d", True, 1.0, 5), ("e", True, 1.0, 9)]
    rows = mixing.schedule(spark.createDataFrame(sources, SOURCES), 13).collect()
    at = {(r[mixing._KEY], r["block"]): r["slot"] for r in rows}
    assert sorted(at.values()) == list(range(151)) and sorted(at) == sorted((k, i) for k, _, _, n in sources for i in range(n))
    for t in range(137):
        want = ideal({"a": 8, "b": 4, "c": 1}, {"a": 100, "b": 7, "c": 30}, t)
        assert all(abs(sum(s < t for (k, _), s in at.items() if k == x) - want[x]) < 1 for x in want)
    assert min(s for (k, _), s in at.items() if k in "de") == 137


def test_blocks_of_one_row(spark):
    """A row for each block is joined, no plan of a whole round."""
    docs = spark.range(0, 90_000, 1, 8).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', 'b') AS source")
    rows = mixing.mixed(docs, {"a": 1, "b": 2}, block=1).select("source", "__mix.position").collect()
    assert sorted(r["position"] for r in rows) == list(range(90_000))
    order = np.empty(90_000, bool)
    for r in rows:
        order[r["position"]] = r["source"] == "a"
    assert np.abs(np.cumsum(order) - np.arange(1, 90_001) / 3).max() < 1


def test_many_sources_and_one_row_many_times(spark):
    docs = spark.range(0, 30_000, 1, 8).selectExpr(
        "IF(id % 3 = 0, NULL, id) AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 5000) END AS source"
    )
    rows = mixing.mixed(docs, block=4).select("doc_id", "source", "__mix.*").collect()
    assert len({r["position"] for r in rows}) == len(rows) == 30_000
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    by = defaultdict(set)
    for r in rows:
        by[r["slot"]].add((r["source"], r["block"]))
    assert all(len(x) == 1 for x in by.values()) and sorted(by) == list(range(len(by)))


def test_query(spark, sf):
    rows = mixing.op1_mixing(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source").collect()
    assert sorted((r["doc_id"], r["source"]) for r in rows) == sorted((r[0], r[1]) for r in docs)
    assert len({r["position"] for r in rows}) == len(rows)
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    by_slot = defaultdict(set)
    for r in rows:
        by_slot[r["slot"]].add((r["source"], r["block"]))
    assert all(len(x) == 1 for x in by_slot.values()) and sorted(by_slot) == list(range(len(by_slot)))
    # in the first phase every source keeps its share to within a block
    sizes = Counter(r["source"] for r in rows)
    total = sum(n**0.5 for n in sizes.values())
    span = max(r["slot"] for r in rows if r["phase"] == 0)
    for t in range(0, span, 3):
        for s, n in sizes.items():
            done = len({r["block"] for r in rows if r["source"] == s and r["slot"] < t})
            assert abs(done - t * n**0.5 / total) < 1


def test_edges_and_clashing_columns(edge, none):
    out = mixing.interleaved(edge, {"a": 3, None: 1, "unheard of": 2}, block=1)
    assert out.columns == edge.columns
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, out.collect())) == sorted(map(key, edge.collect()))
    assert mixing.mixed(none).collect() == []


def test_order_is_the_mixture(spark):
    docs = spark.createDataFrame([(i, "t", "en", "a" if i < 60 else "b", 1) for i in range(80)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r["source"] for r in mixing.interleaved(docs, {"a": 1, "b": 1}, block=1).collect()]
    assert all(abs(got[:t].count("a") - t / 2) < 1 for t in range(40)) and set(got[40:]) == {"a"}
