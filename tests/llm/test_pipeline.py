import numpy as np
import corpus_pipeline
import __spark_entry__ as entry
from strandline.llm import quality, toxicity
from test_similar import brute_roots
from tests_llm_help import brute_pieces


def test_stages(spark, tmp_path):
    """Each stage against its operator's decisions on its own input."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "packing"]
    outs = []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        outs.append((docs, spark.read.parquet(str(tmp_path / str(k)))))
        docs = outs[-1][1]
    ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
    for a, b in outs[:4]:
        assert b.columns == a.columns
    a, b = outs[0]
    assert ids(b) == ids(a.where(toxicity.toxicity(a, labels) < toxicity.CUT))
    a, b = outs[1]
    assert ids(b) == ids(a.where(quality.quality(a, labels) >= quality.CUT))
    a, b = outs[2]
    assert ids(b) == sorted(set(brute_roots([tuple(r) for r in a.select("doc_id", "text").collect()]).values()))
    a, b = outs[3]
    assert ids(a) == ids(b)
    a, b = outs[4]
    rows = [tuple(r) for r in a.select("doc_id", "text").collect()]
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in b.collect()) == brute_pieces(rows)
    # the run as a whole gives the same pieces
    whole = entry.queries()["pipeline"](spark, sf).collect()
    assert sorted((r["doc_id"], r["piece"]) for r in whole) == sorted((r["doc_id"], r["piece"]) for r in b.collect())
    toxic = {r[0] for r in labels.where("toxic = 1").select("doc_id").collect()}
    before, after = ids(outs[0][0]), ids(outs[0][1])
    assert np.mean([i not in after for i in before if i in toxic]) > 0.7  # a few dozen toxic rows to learn from here


def test_edges(spark, edge, none, tmp_path, labels):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for start in (edge, none):
        docs = start
        for name, f in corpus_pipeline.STAGES:
            before, docs = docs, f(spark, docs, str(tmp_path))
            if name != "packing":
                assert docs.columns == before.columns
                # rows stay as they were, clashing columns too
                was = {repr(tuple(r)) for r in before.collect()}
                assert {repr(tuple(r)) for r in docs.collect()} <= was
                docs = spark.createDataFrame(docs.collect(), docs.schema)
                if name == "mixing":
                    assert docs.count() == before.count()
        rows = docs.collect()
        assert len(rows) == (0 if start is none else len(rows)) and all(r["length"] >= 1 for r in rows)
