import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import lexical as lx
from strandline.llm.common import shipped

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) by the formulas, document by document."""
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in set(items):
        scored = []
        for i, w in held:
            m, s = 100 - 75 + (75 * len(w) * n_docs) // total, 0
            for x in terms(text):
                if tf := w.count(x):
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def plain(df):
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect()), key=repr)


ITEMS = [(1, "Two THREE word"), (1, "Two THREE word"), (2, None), (3, ""), (4, "the unknown"), (5, "rights rights reserved übergrößen"), (5, "no id"), (None, "lorem word")]


@pytest.mark.parametrize("size", [1, 3, 16384])
def test_against_brute_force(spark, edge, monkeypatch, size):
    monkeypatch.setattr(lx, "SHARD", size)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("clash"))
    docs = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    assert plain(lx.ranked(edge, items)) == brute(docs, [x for x in ITEMS if x[1] is not None])
    assert plain(lx.ranked(edge, items, 1)) == brute(docs, [x for x in ITEMS if x[1] is not None], 1)


def test_items_in_blocks(spark, edge, monkeypatch):
    monkeypatch.setattr(lx, "TERMS", 3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    assert plain(lx.ranked(edge, items)) == brute(docs, [x for x in ITEMS if x[1] is not None])


def test_no_rows(spark, edge, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lx.ranked(none, items).collect() == [] and lx.ranked(edge, items.limit(0)).collect() == []


@pytest.mark.parametrize("spread", [1, 4])
def test_query_against_sql(spark, sf, spread):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(lx.SQL).fetchall()
    docs = shipped(spark).read.parquet(f"{sf}/documents.parquet").repartition(spread)
    got = lx.op11_ranked_search(spark, sf) if spread == 1 else lx.ranked(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert plain(got) == sorted(want, key=repr)


def cost_of(score, starts, price):
    return sum(score[a:b].max() * (b - a) - score[a:b].sum() + price for a, b in zip(starts, starts[1:]))


def test_cuts_are_the_best(seed=3):
    rng = np.random.default_rng(seed)
    sizes = [0, 1, 9, 0, 12, 7]
    first = np.append(0, np.cumsum(sizes))
    score = rng.integers(1, 100, first[-1])
    got = lx.cuts(score, first, longest=4, cost=0.7)
    assert set(first) <= set(got.tolist())
    for a, b in zip(first, first[1:]):
        if a == b:
            continue
        price = 0.7 * score[a:b].mean()
        best = np.inf
        for cutting in range(1 << (b - a - 1)):
            starts = [a] + [a + i + 1 for i in range(b - a - 1) if cutting >> i & 1] + [b]
            if max(np.diff(starts)) <= 4:
                best = min(best, cost_of(score, starts, price))
        mine = got[(got >= a) & (got <= b)]
        assert max(np.diff(mine)) <= 4 and math.isclose(cost_of(score, mine, price), best)


def test_search_skips_blocks_and_stays_exact():
    rng = np.random.default_rng(8)
    n, t = 4000, 40
    has = rng.random((n, t)) < rng.random(t) ** 3
    tf = rng.geometric(0.6, (n, t))
    doc, term = np.nonzero(has)
    weights = rng.integers(50, 9000, t)
    m = rng.integers(30, 400, n)
    s = lx.shard(np.arange(n), np.zeros(n, np.int64), m, has.sum(1), term, tf[doc, term], weights)
    full = np.where(has, weights * (10**9 * tf // (1000 * tf + 8 * m[:, None])), 0)
    read = every = 0
    for _ in range(50):
        at = np.sort(rng.choice(t, 4, replace=False))
        times = rng.integers(1, 3, 4)
        got, scores, k = lx.search(s, at, times)
        want = (full[:, at] * times).sum(1)
        order = np.lexsort((np.arange(n), -want))[:10]
        got = s.doc_id[got]
        mine = np.lexsort((got, -scores))[:10]
        assert got[mine].tolist() == order.tolist() and scores[mine].tolist() == want[order].tolist()
        read, every = read + k, every + has[:, at].sum()
    assert read < 0.7 * every, read / every
