"""What the operators of this subpackage share: tables, checkpoints, components."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Rows of whole texts sent to a Python worker at once: bounds what JVM and worker hold of them.
BATCH = "4096"


def shipped(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where they see the same path (elsewhere: --py-files), and take ``BATCH`` rows at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def frugal(spark: SparkSession) -> SparkSession:
    """``shipped``, and workers that give freed memory back to the system, where stages of different needs follow each other on the same executors."""
    env = spark.sparkContext.environment
    for k, v in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "1"), ("MALLOC_TRIM_THRESHOLD_", "131072")):
        env.setdefault(k, v)
    return shipped(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's spark.checkpoint.dir; a folder of our own only where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder; lost executors then cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def dealt(spark: SparkSession, partitions: int) -> Iterator[None]:
    """What is executed inside deals its rows to so many partitions, or as many as the session says if those are more, and leaves them apart."""
    most = max(partitions, int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = {"spark.sql.shuffle.partitions": str(most), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sweep(spark: SparkSession) -> None:
    """Drop the shuffle files of rounds whose rows are in a checkpoint: Spark does when the driver's JVM finds their frames unused, which may be long after."""
    gc.collect()
    spark._jvm.System.gc()


def ordered(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """The rows with their number in ``order``, from 1; fixed in the checkpoint folder.

    Rows are dealt by ranges and sorted there; the ranges' sizes (a row each) give where
    each begins. Ties are numbered as they happen to lie.
    """
    at = "__ordered"
    # the id has the partition in its upper 31 bits, the row's place there in the lower 33
    d = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    d = d.withColumns({f"{at}_part": F.shiftright(at, 33), name: F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + 1}).drop(at)
    sizes = d.groupBy(f"{at}_part").agg(F.count("*").alias(f"{at}_n"))
    before = Window.orderBy(f"{at}_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(f"{at}_part", F.coalesce(F.sum(f"{at}_n").over(before), F.lit(0)).alias(f"{at}_base"))
    return d.join(F.broadcast(base), f"{at}_part").withColumn(name, F.col(name) + F.col(f"{at}_base")).drop(f"{at}_part", f"{at}_base")


def held_out(doc_id: Column | str, mod: int, rest: int) -> Column:
    """crc32(doc_id as text) mod ``mod`` is ``rest``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % mod) == rest


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b) by alternating large and small stars.

    Returns (u, v): every vertex but the smallest of its component, with that smallest vertex.
    Each round is a checkpoint, so the plan stays short and survives lost executors.
    Nulls and loops are left out; no edges give no rows.
    """
    e = (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = cut(e)
    last = _signature(e)
    for _ in range(max_rounds):
        if last[0] == 0:
            return e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = cut(small)
        del both, low, large, small
        sweep(e.sparkSession)
        now = _signature(e)
        if now == last:
            return e
        last = now
    raise RuntimeError("components did not settle")
