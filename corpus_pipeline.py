"""Five operators in a row over documents: each stage's rows are written, and read by the next.

Defined results, for every stage: null and empty texts are texts like any other (scored, grouped
with each other, packed as their end mark); very long texts are read whole; ties go to the smaller
doc_id, null last; repeated rows are decided alike, and near_dedup keeps one; an empty table gives
no rows; columns that ``documents`` doesn't have stay to the last stage but one, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import mixing, packing, quality, similar, toxicity
from strandline.llm.common import checkpoint_dir, frugal


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frugal(spark).read.parquet(f"{sf_dir}/labels.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.3 or more) go; without labelled rows none does. Equal texts go or stay together."""
    return toxicity.without_toxic(docs, _labels(spark, sf_dir))


def without_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field rejects (score under 0.7) go; without labelled rows of both kinds none does. Equal texts go or stay together."""
    return quality.without_bad(docs, _labels(spark, sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more) stays: the one of the smallest doc_id, once if repeated. Texts without words are one group."""
    frugal(spark)
    return similar.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated ones too, in the order in which their sources (null: one of its own) have their target weights at every point."""
    return mixing.interleaved(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with the sequence and the offset of each; an empty document is one piece, its end mark."""
    frugal(spark)
    return packing.packed(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("quality", without_bad),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: Learned scores and packings are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever the cluster keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. The rows between two stages lie in the shared checkpoint folder until the next are written;
    those before the last stage stay there, as its rows are read from them."""
    checkpoint_dir(frugal(spark))
    folder = f"{spark.sparkContext.getCheckpointDir()}/stages-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
            if k:
                _drop(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
