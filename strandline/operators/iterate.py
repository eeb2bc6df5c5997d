"""Graph iteration: reach, components, PageRank, projection onto kept types, paths.

Every loop cuts its lineage with checkpoint() each round, so a lost executor costs
one round; frontiers only hold what is new.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph


def _folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; one of our own only where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def laid(df: DataFrame) -> DataFrame:
    """``cut`` as Parquet: for what is read several times, each time a few of its columns and rows. It stays in the folder until the folder goes."""
    spark = df.sparkSession
    df.write.parquet(path := f"{_folder(spark)}/laid-{uuid.uuid4().hex}")
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame) -> DataFrame:
    """``cut`` that also forgets the planner's estimate of size.

    A checkpoint keeps it, and that of a join is the product of both sides: where a round joins
    its table with itself, the number of digits doubles each round, and planning soon takes minutes.
    """
    d, spark = cut(df), df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(d._jdf.javaRDD(), d._jdf.schema()), spark)


def sweep(spark: SparkSession) -> None:
    """Drop the shuffle files of rounds that are laid down: Spark does when the driver's JVM finds their frames unused, which may be long after."""
    gc.collect()
    spark._jvm.System.gc()


#: Rows that a task takes of a table that is dealt by key, about.
PORTION = 1 << 18


def portions(spark: SparkSession, rows: int) -> int:
    """Into how many parts to deal so many rows: tasks then stay as they are while tables grow. The planner joins no parts of a number that is given."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PORTION))


def reach(pairs: DataFrame, starts: DataFrame, hops: int | None = None) -> DataFrame:
    """(start, node_id, hop): what is within ``hops`` steps (of any number without it) of (start) along (node_id, other), at its least distance; start itself at 0."""
    seen = cut(starts.select("start", F.col("start").alias("node_id"), F.lit(0).alias("hop")).distinct())
    front = seen
    for i in count(1) if hops is None else range(1, hops + 1):
        step = front.select("start", "node_id").join(pairs.select("node_id", "other"), "node_id").select("start", F.col("other").alias("node_id")).distinct()
        front = cut(step.join(seen.select("start", "node_id"), ["start", "node_id"], "left_anti").withColumn("hop", F.lit(i)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def components(nodes: DataFrame, pairs: DataFrame, rounds: int = 50) -> DataFrame:
    """(node_id, component): the smallest node_id reachable over (src, dst), whatever the direction.

    Least labels pass to neighbours, then every label takes its own label's (pointer
    jumping), so rounds grow with the logarithm of a component's diameter.
    """
    e = pairs.select("src", "dst")
    e = cut(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    lab = cut(nodes.select("node_id", F.col("node_id").alias("component")))
    for _ in range(rounds):
        near = e.join(lab.withColumnRenamed("node_id", "src"), "src").groupBy(F.col("dst").alias("node_id")).agg(F.min("component").alias("m"))
        low = lab.join(near, "node_id", "left").select("node_id", F.least("component", "m").alias("l"))
        jump = low.select(F.col("node_id").alias("l"), F.col("l").alias("l2"))
        new = fresh(low.join(jump, "l", "left").select("node_id", F.least("l", "l2").alias("component")))
        moved = new.join(lab.withColumnRenamed("component", "old"), "node_id").where("component <> old").isEmpty()
        lab = new
        if moved:
            return lab
    raise RuntimeError("components did not settle")


def pagerank(nodes: DataFrame, pairs: DataFrame, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6, fixed: int | None = None) -> DataFrame:
    """(node_id, rank) over (src, dst): uniform teleport, dangling mass spread evenly; stops at an L1 change under n x tol.

    Nodes and edges stay in their blocks (``tiles``); a round sends each rank once to each block that it leads
    to, and the driver two numbers a block. ``fixed`` runs that many rounds whatever the change.
    """
    from . import tiles

    idx = cut(node_index(nodes))
    at = lambda c, name: idx.select(F.col("node_id").alias(c), F.col("idx").alias(name))
    e = laid(pairs.select("src", "dst").distinct().join(at("src", "s"), "src").join(at("dst", "d"), "dst", "left").select("s", "d"))
    # an edge lies at the node that it leads to, with its weight, and at its source with none, for that to know where to send
    ends = F.explode(F.array(F.struct(F.col("d").alias("a"), F.col("s").alias("b"), F.lit(1.0).alias("w")), F.struct(F.col("s").alias("a"), F.col("d").alias("b"), F.lit(0.0).alias("w"))))
    t = tiles.blocked(laid(e.where("d IS NOT NULL").select(ends.alias("x")).groupBy("x.a", "x.b").agg(F.max("x.w").alias("w"))), idx, both=False)
    deg = tiles.held(t, e.groupBy(F.col("s").alias("idx")).agg(F.count("*").alias("deg")), ["deg"])
    n, blocks, width = t.n, t.blocks, t.width

    def begin(block, x):
        deg = np.zeros(width)
        deg[x["rows"][0]["at"].astype(int)] = x["rows"][0]["deg"]
        rank = np.where(np.arange(width) * blocks + block < n, 1.0 / max(n, 1), 0.0)
        return {"deg": deg, "rank": rank, "loose": rank[deg == 0].sum(), "moved": np.inf}

    note = lambda s: (s["loose"], s["moved"])
    d, notes = tiles.kept(t, tiles.stated(t, begin, deg), note)
    for _ in range(fixed or rounds):
        loose = sum(x[0] for x in notes)

        def take(block, x, messages, loose=loose):
            s, ways = x["state"][0], x["ways"][0]
            got = tiles.times(ways, tiles.far_values(ways, messages, 1), width)[:, 0]
            rank = np.where(np.arange(width) * blocks + block < n, (1 - damping) / max(n, 1) + damping * (got + loose / max(n, 1)), 0.0)
            return {"deg": s["deg"], "rank": rank, "loose": rank[s["deg"] == 0].sum(), "moved": np.abs(rank - s["rank"]).sum()}

        give = lambda s, ids: (s["rank"][ids] / np.maximum(s["deg"][ids], 1))[:, None]
        d, notes = tiles.kept(t, tiles.turned(t, d, tiles.sent(t, d, give), take), note, d)
        if fixed is None and sum(x[1] for x in notes) < n * tol:
            break

    def told(block, s):
        rank = s["rank"][: len(range(block, n, blocks))]
        yield pd.DataFrame({"idx": np.arange(len(rank)) * blocks + block, "rank": rank})

    return tiles.rows_of(t, d, told, "idx long, rank double").join(idx, "idx").select("node_id", "rank")


def collapse_graph(g: Graph, keep: list[str], hops: int = 4, directed: bool = True) -> DataFrame:
    """(src, dst, via): kept nodes that reach each other through removed nodes only; via holds the types passed and the end's own, sorted."""
    typed = g.nodes.select("node_id", "node_type")
    kept = typed.where(F.col("node_type").isin(keep))
    pairs = g.edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other"))
    if not directed:
        pairs = pairs.unionByName(pairs.select(F.col("other").alias("node_id"), F.col("node_id").alias("other"))).distinct()
    pairs = pairs.join(typed.withColumnRenamed("node_id", "other"), "other")
    front = kept.select(F.col("node_id").alias("start"), "node_id", F.array().cast("array<string>").alias("via"))
    found, seen = None, None
    for _ in range(hops):
        step = front.join(pairs, "node_id").select("start", F.col("other").alias("node_id"), F.array_union("via", F.array("node_type")).alias("via"), "node_type").where("start <> node_id")
        step = cut(step.groupBy("start", "node_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("via")))).alias("via"), F.first("node_type").alias("node_type")))
        ends = step.where(F.col("node_type").isin(keep)).select("start", "node_id", "via")
        found = ends if found is None else found.unionByName(ends)
        front = step.where(~F.col("node_type").isin(keep)).select("start", "node_id", "via")
        if seen is not None:
            front = front.join(seen, ["start", "node_id"], "left_anti")
        front = cut(front)
        if front.isEmpty():
            break
        now = front.select("start", "node_id")
        seen = now if seen is None else cut(seen.unionByName(now))
    return found.groupBy(F.col("start").alias("src"), F.col("node_id").alias("dst")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("via")))).alias("via"))


def shortest_to(g: Graph, starts: DataFrame, anchors: DataFrame, hops: int = 6) -> DataFrame:
    """(start, anchor, path): for each start the shortest undirected path to any anchor (ties: the smaller path), start alone if it is one."""
    pairs = g.both_ways().select("node_id", "other").distinct()
    goal = anchors.select("node_id").distinct().withColumn("goal", F.lit(True))
    front = cut(starts.select(F.col("node_id").alias("start"), "node_id", F.array("node_id").alias("path")).distinct())
    done, seen = None, front.select("start", "node_id")
    for i in range(hops + 1):
        marked = front.join(goal, "node_id", "left")
        hit = marked.where("goal").groupBy("start").agg(F.min_by(F.struct(F.col("node_id").alias("anchor"), "path"), "path").alias("x")).select("start", "x.*")
        done = cut(hit if done is None else done.unionByName(hit))
        if i == hops:
            break
        front = front.join(done.select("start"), "start", "left_anti")
        step = front.join(pairs, "node_id").select("start", F.col("other").alias("node_id"), F.concat("path", F.array("other")).alias("path"))
        step = step.join(seen, ["start", "node_id"], "left_anti")
        front = cut(step.groupBy("start", "node_id").agg(F.min("path").alias("path")))  # one path a node: the smallest of the shortest
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front.select("start", "node_id")))
    return done


def restricted(g: Graph, kinds: list[str], hub_cap: int | None = None) -> Graph:
    """Nodes of the kinds, no currency, whatever their degree (of at most ``hub_cap`` edges in the whole graph, if given); edges as they are among them."""
    n = g.nodes.where(F.col("node_type").isin(kinds) & ~F.coalesce("is_currency", F.lit(False)))
    if hub_cap is not None:
        n = n.join(g.total_degree().where(F.col("degree") > hub_cap).select("node_id"), "node_id", "left_anti")
    return Graph(n, Graph(n, g.edges).induced(n).edges)


def substrate(g: Graph, kinds: list[str], hub_cap: int = 500) -> Graph:
    """``restricted``, with undirected edges once (src < dst)."""
    r = restricted(g, kinds, hub_cap)
    e = r.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()
    return Graph(r.nodes, e)


def numbered(d: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their places in an order, from 0. Ranges are numbered apart, then shifted."""
    d = d.repartitionByRange(*order).sortWithinPartitions(*order)
    d = cut(d.withColumn("__p", F.spark_partition_id()).withColumn("__k", F.monotonically_increasing_id()))
    w = Window.partitionBy("__p").orderBy("__k")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy("__p").agg(F.count("*").alias("c")).select("__p", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__b"))  # one row a partition
    d = d.withColumn(name, F.row_number().over(w) - 1).join(F.broadcast(sizes), "__p")
    return d.withColumn(name, F.col(name) + F.col("__b")).drop("__p", "__k", "__b")


def node_index(nodes: DataFrame) -> DataFrame:
    """(node_id, idx): places in order of id, from 0."""
    return numbered(nodes.select("node_id").distinct(), [F.col("node_id")], "idx")


def bypass(g: Graph) -> DataFrame:
    """(src, dst, rel): reactions replaced by substrate-product, gene-substrate and gene-product edges."""
    s = g.edges.where("rel = 'substrate'").select(F.col("dst").alias("r"), F.col("src").alias("s"))
    p = g.edges.where("rel = 'product'").select(F.col("src").alias("r"), F.col("dst").alias("p"))
    c = g.edges.where("rel = 'catalysis'").select(F.col("dst").alias("r"), F.col("src").alias("c"))
    pair = lambda a, b, x, y, rel: a.join(b, "r").select(F.col(x).alias("src"), F.col(y).alias("dst"), F.lit(rel).alias("rel"))
    out = pair(s, p, "s", "p", "substrate_product").unionByName(pair(c, s, "c", "s", "gene_substrate")).unionByName(pair(c, p, "c", "p", "gene_product"))
    return out.where("src <> dst").distinct()


def largest_component(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Of (keys, node_id) sets, the members of each set's largest component in the induced graph (ties: the smallest id)."""
    key = F.concat_ws("\x01", *keys, "node_id")
    n = nodes.select(*keys, "node_id", key.alias("__id"))
    a = n.select(*keys, F.col("node_id").alias("src"), F.col("__id").alias("__s"))
    b = n.select(*keys, F.col("node_id").alias("dst"), F.col("__id").alias("__d"))
    e = edges.select("src", "dst").join(a, "src").join(b, [*keys, "dst"]).select(F.col("__s").alias("src"), F.col("__d").alias("dst"))
    c = n.join(components(n.select(F.col("__id").alias("node_id")), e).withColumnRenamed("node_id", "__id"), "__id")
    size = c.groupBy(*keys, "component").agg(F.count("*").alias("__n"))
    best = size.groupBy(*keys).agg(F.min_by("component", F.struct(-F.col("__n"), "component")).alias("component"))
    return c.join(best, [*keys, "component"]).select(*keys, "node_id")
