import math
import re
import zlib

import numpy as np
import pyarrow as pa

from strandline.llm import toxicity as tox


def rest(i):
    return zlib.crc32((str(i) if i is not None else "").encode()) % 4


def test_held_out_rows_are_told_apart(spark):
    d = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in tox.op5_toxicity(spark, d).collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r["held_out"] == (rest(i) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    lab = [(got[r["doc_id"]], r["toxic"]) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r["doc_id"] in got]
    held = [(r["predicted"], y) for r, y in lab if r["held_out"]]
    assert np.mean([p == y for p, y in held]) > 0.95
    clean, bad = ([p for p, y in held if y == label] for label in (0, 1))
    assert np.mean(clean) < 0.02
    # some six in a hundred toxic labels stand on texts that have nothing of the others
    assert np.mean(bad) > 0.9


def test_edges(spark, edge, none, labels):
    scores = edge.select("doc_id", "text", tox.toxicity(edge, labels).alias("s")).collect()
    by = {}
    for r in scores:
        assert 0 <= r["s"] <= 1
        by.setdefault(r["text"] or "", set()).add(r["s"])
    assert all(len(x) == 1 for x in by.values())
    kept = tox.without_toxic(edge, labels)
    assert kept.columns == edge.columns
    assert none.select(tox.toxicity(none, labels)).collect() == []
    blank = labels.limit(0)
    assert {r[0] for r in edge.select(tox.toxicity(edge, blank)).collect()} == {0.5}


def test_ftrl_finds_the_word():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(0, 1000, 20), [5] if i % 3 == 0 else [])).astype(int) for i in range(600)]
    y = np.array([float(i % 3 == 0) for i in range(600)])
    w, b = tox.ftrl(rows, y)
    assert w[5] > 1 and np.argmax(w) == 5 and (w != 0).sum() < 200  # sparse
    p = np.array([1 / (1 + np.exp(-(w[r].sum() + b))) for r in rows])
    assert ((p > 0.3) == (y == 1)).mean() > 0.95


def test_features_are_sets_of_the_whole_text():
    a, b = tox.features_of.func(pa.array(["A b c", None, "a B c a b c"])).to_pylist()[::2]
    assert set(a) < set(b) and len(set(a)) == len(a) and len(a) == 3 + 2 + 1


def plain_features(text):
    """Named features of a text: words, pairs, skip pairs, stems."""
    w = [x.encode() for x in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    out = {("word", x) for x in w} | {("pair", *p) for p in zip(w, w[1:])} | {("skip", *p) for p in zip(w, w[2:])}
    return out | {("stem", n, x[:n]) for x in w for n in tox.STEMS if len(x) > n}


def test_features_against_named_ones():
    """One slot for each named feature, the same in every text."""
    texts = ["Abcdefghij klm, abcdefgh; übergrößenträger x", "klm abcdefghij abcd abcde", "", "a a a a", "abcdefghij", "Übergröße klm"]
    slots, at = tox.features_of.func(pa.array(texts)).to_pylist(), {}
    for text, got in zip(texts, slots):
        assert len(got) == len(plain_features(text))
    names = [plain_features(x) for x in texts]
    for f in set().union(*names):
        at[f] = set.intersection(*(set(s) for s, n in zip(slots, names) if f in n)) - set().union(*(set(s) for s, n in zip(slots, names) if f not in n))
        assert at[f], f


def plain_ftrl(rows, y, alpha=1.0, beta=1.0, l1=10.0, epochs=3):
    """The steps coordinate by coordinate, in dictionaries."""
    z, n, bias = {}, {}, "bias"

    def weight(k):
        x = z.get(k, 0.0)
        most = 0.0 if k == bias else l1
        return 0.0 if abs(x) <= most else -math.copysign(abs(x) - most, x) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(np.arange(len(y))):
            keys = [*rows[i], bias]
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y[i]
            for k in keys:
                old = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[k]
                n[k] = old + g * g
    return {k: weight(k) for k in z if weight(k)}


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(3)
    y = (rng.random(150) < 0.3).astype(float)
    rows = [np.unique(np.append(rng.integers(0, 60, 8), [70, 71] if y[i] else [72])).astype(int) for i in range(150)]
    for l1 in (0.5, 3.0):
        w, b = tox.ftrl(rows, y, l1=l1, epochs=3)
        want = plain_ftrl([r.tolist() for r in rows], y, l1=l1)
        assert np.isclose(b, want.pop("bias")) and set(np.flatnonzero(w)) == set(want)
        assert all(np.isclose(w[k], v) for k, v in want.items())
