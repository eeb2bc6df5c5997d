import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import similar
from strandline.llm import textops as tx


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_roots(rows):
    """rows: (doc_id, text); for each distinct shingle set the smallest doc_id its links reach, by all pairs that share a shingle."""
    ids = defaultdict(list)
    for i, t in rows:
        ids[shingles(t)].append(i)
    sets = list(ids)
    up = list(range(len(sets)))

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    has = defaultdict(list)
    for n, s in enumerate(sets):
        shared = Counter(m for x in s for m in has[x])
        for m, c in shared.items():
            if 5 * c >= 4 * (len(s) + len(sets[m]) - c):
                up[find(n)] = find(m)
        for x in s:
            has[x].append(n)
    least = defaultdict(list)
    for n, s in enumerate(sets):
        least[find(n)] += ids[s]
    return {i: min(x) for x in least.values() for i in x}


def test_shingles():
    texts = ["One two THREE four five six", "a b", "", "x", "p q r s t", "a b"]
    for i, j, t in tx.chunks(pa.array(texts)):
        h, first = similar.shingles(t)
    assert np.diff(first).tolist() == [2, 1, 0, 1, 1, 1]
    assert h[first[1]] == h[first[5]] and len(set(h.tolist())) == 5
    for i, j, t in tx.chunks(pa.array(["two three four five six", "one two three four five"])):
        other, _ = similar.shingles(t)
    assert set(other.tolist()) == set(h[:2].tolist())


@pytest.mark.parametrize("leaders", [1, 3])
def test_groups_against_all_pairs(spark, leaders, monkeypatch):
    monkeypatch.setattr(similar, "LEADERS", leaders)
    monkeypatch.setattr(similar, "MORE", 2)
    rng = random.Random(1)
    rows, word = [], lambda: f"w{rng.randrange(3000)}"
    for n in (2, 3, 40, 150):
        body = [word() for _ in range(80)]
        for _ in range(n):
            w = list(body)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
            if rng.random() < 0.05:
                body = w  # groups drift, so their ends aren't alike
    common = " ".join(word() for _ in range(40))
    rows += [f"{common} " + " ".join(word() for _ in range(40)) for _ in range(30)]
    rows += ["", None, "a b c", "A b c", "same words again and again and again"] + [rows[5]] * 20
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS cls", "'x' AS fp", "'x' AS `set`", "1 AS n", "2 AS root")
    got = sorted(r["doc_id"] for r in similar.deduplicated(docs).collect())
    assert got == sorted(set(brute_roots(rows).values()))


def test_recall_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"] for r in similar.deduplicated(docs).select("doc_id").collect()}
    want = set(brute_roots(rows).values())
    assert want <= got and len(got) <= len(want) + 0.01 * (len(rows) - len(want))


def test_pivot_cells_choose_candidates(spark):
    """Pairs within two bits are found by the pivot tables alone: no two classes share a key of minima here."""
    text = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "something else that is like neither of these texts at all")], "doc_id long, text string")
    bands = F.transform(F.col("bands"), lambda b: F.xxhash64(b, "cls"))
    lone = similar.classes(docs).withColumn("bands", bands)
    fps = [r["fp"] for r in lone.where("n > 100").collect()]
    assert ((fps[0] ^ fps[1]) & (2**64 - 1)).bit_count() <= 2
    assert len({r["root"] for r in similar.roots(lone, docs).collect()}) == 1
