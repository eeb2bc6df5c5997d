import hashlib
import re
import struct

import xxhash
from pyspark.sql import functions as F

from strandline.llm import order_minhash as om

MASK = (1 << 64) - 1


def of_bytes(x, seed=42):
    return xxhash.xxh64_intdigest(x, seed)


def chained(*parts):
    """Spark's hash of several values: each seeds the next; None leaves the seed."""
    seed = 42
    for kind, x in parts:
        if x is not None:
            seed = of_bytes(struct.pack("<q" if kind == "long" else "<i", x - (1 << 64) * (x >> 63)), seed)
    return seed


def brute(text, k=om.K, tuples=om.TUPLES):
    """The signature by the definition: numbered k-mers as a list, all hashes of each, minima by a loop."""
    w = re.findall(r"[^ \t\n\x0b\f\r]{1,16}", text)
    starts = range(max(1, len(w) - k + 1)) if w else []
    seen, elements = {}, []
    for place in starts:
        h = 42
        for x in w[place : place + k]:
            h = of_bytes(x.encode(), h)
        seen[h] = seen.get(h, 0) + 1
        elements.append((place, chained(("long", h), ("long", seen[h]))))
    out = []
    for t in range(tuples):
        seed = (2 * t + 1) * 0x9E3779B97F4A7C15 & MASK
        least = [None, None]
        for place, e in elements:
            h = chained(("long", e ^ seed))
            # of equal leading bits the earlier place is less
            x = (h >> 2 >> om.PLACE, place)
            if least[h & 1] is None or x < least[h & 1]:
                least[h & 1] = x
        (e, a), (o, b) = (x or (None, -1) for x in least)
        parts = [("int", 0), ("long", e)], [("int", 1), ("long", o)]
        out.append(chained(*(parts[0] + parts[1] if a <= b else parts[1] + parts[0])) >> 48)
    return "".join(f"{x:04x}" for x in out)


def share(a, b):
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)


def edits(rows):
    """(doc_id, text) rows in the operator's order: a text and its edit."""
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        q = len(text) // 3
        yield i, text, text[: len(text) - q] + after[:q], after


def check(got, rows):
    want = {}
    for i, text, edited, after in edits(rows):
        f, e = brute(text), brute(edited)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        want[i, len(text)] = (sha, f, e, share(f, e), share(f, brute(after)))
    assert {(r["doc_id"], r["n_chars"]) for r in got} == set(want)
    for r in got:
        assert (r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) == want[r["doc_id"], r["n_chars"]]


def test_against_brute_force(spark, edge):
    got = om.edited_fingerprints(edge).collect()
    assert len(got) == edge.count()  # repeated rows have a row each
    rows = {(r["doc_id"], r["text"] or "") for r in edge.select("doc_id", "text").collect()}
    check(got, sorted(rows, key=lambda r: -(r[0] or 0)))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted(((r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()), reverse=True)
    got = om.op13_order_minhash(spark, sf).collect()
    assert len(got) == len(rows)
    check(got, rows)


def test_one_document_follows_itself(spark):
    got = om.edited_fingerprints(spark.createDataFrame([(5, "a b c d e f g h i")], "doc_id long, text string")).collect()
    check(got, [(5, "a b c d e f g h i")])
    assert got[0]["near_next"] == 1.0


def test_more_edits_less_likeness(spark):
    words = [f"w{i}" for i in range(3000)]
    swapped = words[1500:] + words[:1500]
    changed = [w if i % 20 else "x" + w for i, w in enumerate(words)]
    torn = [w if i % 3 else "x" + w for i, w in enumerate(words)]
    texts = [" ".join(x) for x in (words, changed, swapped, torn)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    f = {r["doc_id"]: r["fingerprint"] for r in om.fingerprints(d, tuples=48).collect()}
    assert f[0] == brute(texts[0])
    near = [share(f[0], f[i]) for i in range(4)]
    # the swap keeps all elements but half of the orders
    assert near[0] == 1 and near[1] > 0.5 and 0.25 < near[2] < 0.75 and near[3] < 0.3


def test_equal_texts_and_texts_without_words(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, None), (4, " \n"), (5, "x" * 50)], "doc_id long, text string")
    f = {r["doc_id"]: r["fingerprint"] for r in om.fingerprints(d).collect()}
    assert f[1] == f[2] and f[3] == f[4] != f[1] and f[5] == brute("x" * 50)
    assert len(f[3]) == 4 * om.TUPLES


def test_no_rows(none):
    assert om.edited_fingerprints(none).collect() == [] and om.fingerprints(none).collect() == []


def test_no_python_on_the_main_path(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.col("text").alias("kept"), F.col("text").alias("edited"))
    plan = om.signatures(d.repartition("doc_id"), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert plan.count("Exchange") == 1  # k-mers aren't shuffled
