import random
import re

import pytest
import xxhash

from strandline.llm import simhash, similar


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    votes = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            votes[b] += (h >> b) & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(s))


def brute_classes(rows):
    """rows: (doc_id, unsigned fp); smallest reachable id of each fp by all pairs."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def find(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                up[find(a)] = find(b)
    least = {}
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return {f: least.get(find(f)) for f in fps}


def test_query_against_brute_force(spark, edge):
    got = simhash.near_duplicates(edge).collect()
    rows = [(r["doc_id"], brute(r["text"])) for r in edge.select("doc_id", "text").collect()]
    want = brute_classes(rows)
    assert sorted((repr(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == sorted((repr(i), f"{f:016x}", want[f]) for i, f in rows)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r[0], brute(r[1])) for r in docs.select("doc_id", "text").collect()]
    want = brute_classes(rows)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op3_simhash(spark, sf).collect()}
    assert got == {i: (f"{f:016x}", want[f]) for i, f in rows}


@pytest.mark.parametrize("crowd", [2, 64])
def test_links_of_crowds(spark, crowd):
    rng = random.Random(crowd)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(15):
            f = base
            for _ in range(rng.randrange(6)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps |= {0, (1 << 64) - 1, 1 << 63}
    rows = [(i, f) for i, f in enumerate(sorted(fps, key=lambda f: f * 0x9E3779B97F4A7C15 % 2**64))]
    df = spark.createDataFrame([(i, f - (1 << 64) * (f >> 63)) for i, f in rows], "doc_id long, fp long")
    got = {r["fp"] % (1 << 64): r["component_id"] for r in simhash.classes(df, crowd=crowd).collect()}
    assert got == brute_classes(rows)


def test_one_of_each_group_stays(spark, edge):
    kept = similar.deduplicated(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # 1 and 2 are copies, 3 4 and 5 have no words; no id is smallest only where there is no other
    assert sorted(ids, key=repr) == sorted([1, 3, None, 6, 7, 8], key=repr)


def test_no_rows(none):
    assert simhash.near_duplicates(none).collect() == []
    assert similar.deduplicated(none).collect() == []
