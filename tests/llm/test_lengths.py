import public_tokenizers
from tokenizers import Tokenizer

from strandline.llm import lengths


def held(docs, got):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for x in docs]
    want = [
        (k, n.count(k), sum(x >= k for x in n), sum(x for x in n if x >= k), sum(min(x, k) for x in n), sum(x < k for x in n) / len(n))
        for k in sorted(set(n))
    ]
    assert sorted(tuple(r) for r in got) == want
    return n


def test_query(spark, sf):
    docs = [r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    held(docs, lengths.op10_token_counts(spark, sf).collect())


def test_edges(edge, none):
    hist = lengths.histogram(edge)
    n = held([r["text"] for r in edge.collect()], lengths.with_suffix_sums(hist).collect())
    got = {r["limit"]: (r["truncated_tokens"], r["docs_cut"]) for r in lengths.totals(hist, [0, 3, 10**6]).collect()}
    assert got == {k: (sum(min(x, k) for x in n), sum(x > k for x in n)) for k in (0, 3, 10**6)}
    q = {r["q"]: r["length"] for r in lengths.quantiles(lengths.with_suffix_sums(hist), [0.5, 1.0]).collect()}
    assert q == {0.5: sorted(n)[-(-len(n) // 2) - 1], 1.0: max(n)}
    assert lengths.with_suffix_sums(lengths.histogram(none)).collect() == []
