import hashlib
import math
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.llm import importance as im
from strandline.llm.common import ordered, shipped

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, n=1):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, ngram=1, buckets=10_000, least=20, percent=10):
    def counted(texts):
        c = [0] * buckets
        for t in texts:
            for f in features(t, ngram)[1]:
                c[zlib.crc32(f.encode()) % buckets] += 1
        return c

    s, t = counted([x for _, x in docs]), counted(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, f = features(text, ngram)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = len(able) * percent // 100
    out = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if not r[4]]
    return sorted(out, key=repr)


def plain(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("ngram,buckets,least,percent", [(1, 10_000, 20, 10), (3, 97, 2, 70), (2, 1, 0, 100)])
def test_against_brute_force(spark, edge, ngram, buckets, least, percent):
    texts = ["One lorem TWO reserved", None, "", "Übergrößen ipsum ipsum"]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string").withColumn("bucket", F.lit("clash"))
    docs = [(r["doc_id"], r["text"]) for r in edge.select("doc_id", "text").collect()]
    got = im.resampled(edge, target, ngram, buckets, least, percent)
    assert plain(got) == brute(docs, texts, ngram, buckets, least, percent)
    assert plain(im.resampled(edge, target.limit(0), ngram, buckets, least, percent)) == brute(docs, [], ngram, buckets, least, percent)


def test_query_against_sql_and_brute_force(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = plain(im.op12_importance(spark, sf))
    assert got == sorted(con.execute(im.SQL).fetchall(), key=repr)
    docs, target = con.execute("SELECT doc_id, text FROM documents").fetchall(), con.execute("SELECT text FROM benchmark").fetchall()
    assert got == brute(docs, [x[0] for x in target])


def test_texts_over_several_chunks(spark, edge, monkeypatch):
    monkeypatch.setattr(im, "CHUNK", 100)
    docs = shipped(spark).createDataFrame([(i, "some words of text " * (i % 7)) for i in range(200)], "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([("words text",)], "text string")
    assert plain(im.resampled(docs, target)) == brute([(r[0], r[1]) for r in docs.collect()], ["words text"])


def test_no_rows(spark, none):
    assert im.resampled(none, spark.createDataFrame([("a b",)], "text string")).collect() == []


def test_rows_are_numbered_in_order(spark):
    d = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), F.lit(1).alias("at_part")).repartition(7)
    got = [(r["n"], r["x"]) for r in ordered(d, F.desc("x"), name="n").collect()]
    assert sorted(got) == list(enumerate(sorted((r["x"] for r in d.collect()), reverse=True), 1))
