"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer.

Documents are aggregated by encoded length, so all that follows works on one row
per length. For every length occurring, as a context limit, suffix sums give how
many documents are as long or longer, their tokens, and the tokens that remain
if every document is cut to the limit; the same sums give quantiles.

The suffix sums are in two levels (ranges of ``RANGE`` lengths, then inside a
range), so no task needs more rows than there are ranges or lengths in one.

Defined results: null and empty texts have length zero; repeated rows count each;
no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from . import tokens
from .common import cut, table

VOCABULARY = "word_bpe_49k.json"
RANGE = 1024


def length_of(vocabulary: str = VOCABULARY):
    """An Arrow function from texts to their numbers of tokens."""

    @F.arrow_udf(T.LongType())
    def length(text: pa.Array) -> pa.Array:
        ids = tokens.encoder(vocabulary).encode(tokens.text_bytes(text))
        return pa.array([len(x) // 4 for x in ids], pa.int64())

    return length


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """length, n_docs: fixed in the checkpoint folder, as it is small and dear."""
    return cut(docs.select(length_of(vocabulary)("text").alias("length")).groupBy("length").agg(F.count("*").alias("n_docs")))


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """Adds docs_at_least, tokens_at_least, truncated_tokens (all documents cut to this length) and share_below."""
    h = hist.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("range", F.floor(F.col("length") / RANGE))
    ranges = h.groupBy("range").agg(F.sum("n_docs").alias("rd"), F.sum("n_tokens").alias("rt"))
    # one row per range of lengths: bounded by the longest text, not by the number of documents
    later = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranges = ranges.select(
        "range",
        F.coalesce(F.sum("rd").over(later), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("rt").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("rd").over(every).alias("docs"),
        F.sum("rt").over(every).alias("tokens"),
    )
    up = Window.partitionBy("range").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(ranges, "range").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(up) + F.col("docs_after")).alias("docs_at_least"),
        (F.sum("n_tokens").over(up) + F.col("tokens_after")).alias("tokens_at_least"),
        "docs",
        "tokens",
    )
    return out.select(
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        ((F.col("docs") - F.col("docs_at_least")) / F.col("docs")).alias("share_below"),
    )


def totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, truncated_tokens and docs_cut for given context limits, occurring as lengths or not."""
    each = hist.withColumn("limit", F.explode(F.array(*(F.lit(int(x)).cast("long") for x in limits))))
    return each.groupBy("limit").agg(
        F.sum(F.least("length", "limit") * F.col("n_docs")).alias("truncated_tokens"),
        F.sum(F.when(F.col("length") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_cut"),
    )


def quantiles(sums: DataFrame, qs: list[float]) -> DataFrame:
    """q, length: the least length such that a share of q or more of the documents is as long or shorter."""
    share = F.col("share_below") + F.col("n_docs") * (F.lit(1.0) - F.col("share_below")) / F.col("docs_at_least")
    return (
        sums.select("length", share.alias("share"), F.explode(F.array(*map(F.lit, qs))).alias("q"))
        .where(F.col("share") >= F.col("q") - 1e-12)
        .groupBy("q")
        .agg(F.min("length").alias("length"))
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_suffix_sums(histogram(table(spark, sf_dir, "documents")))
