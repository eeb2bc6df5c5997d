"""Evidence that keeps arriving, as a structured stream (an extension: batch scoring needs none of it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def windowed_effects(stream: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """(window, node_id, net_effect, n_records) of (ts, node_id, effect_size, confidence) rows; rows later than ``delay`` are left out, and state with them."""
    w = stream.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("window"), "node_id")
    return w.agg((F.sum(F.col("effect_size") * F.col("confidence")) / F.count("*")).alias("net_effect"), F.count("*").alias("n_records"))


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends evidence to Parquet by node type's prefix, once each; runs until what is there has been read."""
    out = stream.withColumn("kind", F.substring_index("node_id", ":", 1))
    return out.writeStream.partitionBy("kind").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
