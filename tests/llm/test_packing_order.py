from pyspark.sql import functions as F

from strandline.llm import mixing, packing
from strandline.llm.common import cut, shipped


def test_sequences_follow_the_mixture(spark, tmp_path):
    """Of 2,000 and 500 documents the mixture takes two to one until the second source ends; so do sequences, while all of them hold four to one."""
    hot = F.col("id") % 5 != 0
    text = F.concat_ws(" ", F.array_repeat(F.lit("word"), (F.col("id") % 7 + 1).cast("int")))
    docs = shipped(spark).range(2500).select(F.col("id").alias("doc_id"), F.when(hot, "hot").otherwise("cold").alias("source"), text.alias("text"))
    mixing.interleaved(docs).write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "mixed"))
    mixed = spark.read.parquet(str(tmp_path / "mixed"))
    got = packing.packed(mixed, length=16, group=128).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(2500))
    numbers = sorted({r["sequence_id"] for r in got})
    for share in (0.1, 0.25, 0.5):
        first = set(numbers[: int(share * len(numbers))])
        met = [r["doc_id"] % 5 == 0 for r in got if r["sequence_id"] in first]
        assert abs(sum(met) / len(met) - 1 / 3) < 0.04
    # groups of rows that come from no file follow partitions
    plain = packing.packed(cut(mixing.interleaved(docs)), length=16, group=128).collect()
    first = set(sorted({r["sequence_id"] for r in plain})[: len(numbers) // 4])
    met = [r["doc_id"] % 5 == 0 for r in plain if r["sequence_id"] in first]
    assert abs(sum(met) / len(met) - 1 / 3) < 0.04
