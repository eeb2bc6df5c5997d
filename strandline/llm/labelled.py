"""A bounded sample of labelled documents on which the classifiers of this subpackage are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: How many more rows than wanted pass the threshold, so that enough do.
SPARE = 1.2


def training_rows(docs: DataFrame, labels: DataFrame, target: str, most: int, mod: int = 4, rest: int = 2) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents that aren't held out.

    The labels are ordered by a hash of their id, so the sample is the same in every
    run. An estimated count first sets a threshold that little more than ``most`` ids
    pass, so tasks sort and send no more than those in all. ``most`` bounds what is
    broadcast and gathered: ids and labels, then a text for each id.
    Labels without an id or of other than 0 and 1, and documents without a label, take
    no part; of several texts under one id the smallest does (a null one is empty).
    """
    known = (
        labels.select("doc_id", F.col(target).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
        .where(~held_out("doc_id", mod, rest))
        .withColumn("at", F.xxhash64(F.lit(7), "doc_id"))
    )
    n = known.agg(F.approx_count_distinct("doc_id", 0.02)).first()[0]
    if n > SPARE * most:
        known = known.where(F.col("at") < int((SPARE * most / n * 2 - 1) * (1 << 63)))
    picked = known.groupBy("doc_id", "at").agg(F.max("y").alias("y")).orderBy("at", "doc_id").limit(most).select("doc_id", "y")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
