import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import gru, lm
from strandline.llm import textops as tx


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows):
    c = Counter()
    for i, text in rows:
        if zlib.crc32((str(i) if i is not None else "").encode()) % 5 != 1:
            c.update([*words(text), "\0end"])
    n, v = sum(c.values()), len(c)
    out = []
    for i, text in rows:
        w = [*words(text), "\0end"]
        out.append((repr(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return sorted(out)


def held_to(got, rows):
    got = sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    want = brute(rows)
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert np.allclose([x[4] for x in got], [x[4] for x in want], rtol=1e-10)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = lm.op8_language_model(spark, sf).collect()
    held_to(got, rows)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edges(spark, edge, none):
    held_to(lm.scored(edge, 5).collect(), [(r["doc_id"], r["text"]) for r in edge.collect()])
    assert lm.scored(none).collect() == []
    only_held_out = edge.where("crc32(cast(coalesce(cast(doc_id as string), '') as binary)) % 5 = 1")
    got = lm.scored(only_held_out).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in got)
    held_to(got, [(r["doc_id"], r["text"]) for r in only_held_out.collect()])


def model(seed=0):
    texts = ["the cat sat on the mat . " * 3, "a dog , a dog ran far away", "éclair the end"] * 4
    h = np.concatenate([gru.words_of(t)[1] for _, _, t in tx.chunks(pa.array(texts))])
    v = gru.vocabulary(h, len(texts), most=8)
    ids, first = lm.token_ids(pa.array(texts), v)
    return gru.Model(v, units=5, seed=seed), [ids[a:b] for a, b in zip(first, first[1:])], ids, first


def test_probabilities_sum_to_one():
    m, _, _, _ = model()
    h = np.random.default_rng(0).normal(size=(1, 5)).astype(np.float32)
    every = np.arange(m.v.end + 1 + gru.RARE)  # frequent words, the end, and classes of others
    p = np.exp(m.output(np.repeat(h, len(every), 0), every)[0])
    assert p.sum() == pytest.approx(1, abs=1e-5)


def test_state_is_carried_over_windows():
    m, docs, ids, first = model()
    whole, cut = m.score(ids, first, window=1000), m.score(ids, first, window=2)
    assert np.allclose(whole, cut, rtol=1e-5)
    one = []
    for d in docs:
        h, last, total = np.zeros((1, 5), np.float32), m.start, 0.0
        for i in d:
            h = m.step(m.p["x"][[last]], h)[0]
            total += float(m.output(h, np.array([i]))[0][0])
            last = i
        one.append(total / math.log(10))
    assert np.allclose(whole, one, rtol=1e-4)


def test_gradients_against_differences():
    m, docs, ids, first = model()
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    seen = {}
    rate, clone = 1e-3, {k: v.copy() for k, v in m.p.items()}

    def loss():
        return sum(m.score(d, np.array([0, len(d)]))[0] for d in docs[:1]) * math.log(10)

    # one window over one document: its gradients must be those of its log-probability
    h, kept, hs, before = np.zeros((1, 5)), [], [], np.concatenate([[m.start], docs[0][:-1]])
    for b in before:
        nxt, z, r, n, c = m.step(m.p["x"][[b]], h)
        kept.append((h, z, r, n, c))
        h = nxt
        hs.append(h)
    g = {k: np.zeros_like(v) for k, v in m.p.items()}
    _, dh = m.output(np.concatenate(hs), docs[0], g)
    for name in ("cw", "cb", "ww", "wb"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        m.p[name][at] += 1e-5
        up = loss()
        m.p[name][at] -= 2e-5
        down = loss()
        m.p[name][at] += 1e-5
        seen[name] = (g[name][at], (up - down) / 2e-5)
    assert all(a == pytest.approx(b, rel=2e-2, abs=1e-3) for a, b in seen.values()), seen
    assert rate and clone and dh.shape == (len(docs[0]), 5)


def test_fitting_helps():
    m, docs, ids, first = model()
    before = m.score(ids, first).sum()
    said = m.fit(docs, epochs=30, streams=4, window=8)
    assert said[-1] > said[0] and m.score(ids, first).sum() > before / 2


def test_counts_do_not_depend_on_what_is_broadcast(spark, edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    for most in (0, 3, 20):
        held_to(lm.scored(edge, 1, most).collect(), rows)


def test_common_words_are_all_from_a_count_on(spark):
    rows = [(i, i % 32, max(0, n - 1), n) for i, n in enumerate([1] * 50 + [2] * 20 + [9] * 10 + [100] * 3)]
    totals = spark.createDataFrame(rows, lm._COUNTS)
    for most, size in ((1000, 83), (82, 33), (33, 33), (32, 13), (5, 3), (2, 0)):
        c = lm.common_words(totals, most)
        assert len(c.words) == size and (np.diff(c.words.astype(np.int64)) > 0).all()
    v = lm.vocabulary(lm.common_words(totals), 5)
    assert set(v.hashes.tolist()) == {i for i, _, seen, _ in rows if seen}


def test_score_against_a_plain_model(spark):
    """Every word's probability by hand: the class from the network, the word in it from a softmax or from counts."""
    docs = spark.createDataFrame([(i, f"The cat {i % 3} sat on mat{i % 5}, eé{i % 7} the end . " * (1 + i % 4)) for i in range(40)], "doc_id long, text string")
    rows = [tuple(r) for r in docs.collect()]
    seen = {}
    fit = lm.fit

    def kept(*a):
        seen["model"] = fit(*a)
        return seen["model"]

    lm.fit = kept
    frequent, gru.FREQUENT = gru.FREQUENT, 6
    try:
        got = {r["doc_id"]: r["score"] for r in lm.scored(docs, 2, 9).collect()}
    finally:
        lm.fit, gru.FREQUENT = fit, frequent
    m = seen["model"]
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in words(t))

    def place(w):
        (_, _, t), = tx.chunks(pa.array([w]))
        _, h, rare = gru.words_of(t)
        return int(m.v.ids(h, rare)[0])

    ids = {w: place(w) for w in {w for _, t in rows for w in words(t)}}
    classes = {}
    for w, n in c.items():
        if ids[w] > m.v.end:
            classes.setdefault(ids[w], []).append(n)
    for i, t in rows:
        h, last, total = np.zeros((1, m.units), np.float32), m.start, 0.0
        for w in [*words(t), None]:
            h = m.step(m.p["x"][[last]], h)[0]
            last = m.v.end if w is None else ids[w]
            total += float(m.output(h, np.array([last]))[0][0]) / math.log(10)
            if last > m.v.end:
                of = classes.get(last, [])
                total += math.log10((c[w] + 0.5) / (sum(of) + 0.5 * (len(of) + 1)))
        assert got[i] == pytest.approx(total, rel=1e-4)
