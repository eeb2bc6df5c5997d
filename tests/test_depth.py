"""Closures have no depth at which they stop."""

from strandline.plans import registry
from strandline.sources import graphs


def test_hierarchy_closure_of_many_levels(spark, tmp_path):
    keys = [0] + [3**i for i in range(15)]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["root"]: r["n_descendants"] for r in registry.QUERIES["hierarchy_closure"](spark, str(tmp_path)).collect()}
    assert got == {k: len(keys) - i for i, k in enumerate(keys)}


def test_descendants_of_many_levels(spark):
    terms = spark.createDataFrame([(f"T:{i}", [f"T:{i - 1}"] if i else []) for i in range(34)], "term_id string, parents array<string>")
    assert graphs.descendants(terms, ["T:0"]).count() == 34
