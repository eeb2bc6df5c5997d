"""Connecting chosen nodes: distance cells, Steiner trees, seeds that grow from one another.

All functions take symmetric pairs (node_id, other) and work on many sets at once, by a
column ``set``. Nodes are numbers in blocks (``tiles``): a round sends what changed to the blocks that
have neighbours, for all sets at once; names come back at the end. A set's nodes are never gathered.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph
from . import tiles
from .iterate import components, fresh, largest_component, node_index, numbered
from .iterate import laid as cut  # as columns: what is laid down here is long, narrow and read in parts
from .tiles import Tiles

#: Links of a set that a task takes; rounds of labels that pass between neighbours before pairs are joined instead.
LINKS, ROUNDS = 1 << 20, 24
#: Names that are sent to every task, at most.
NAMES = 1 << 18
NONE = np.iinfo(np.int64).max


def undirected(g: Graph) -> DataFrame:
    """(node_id, other), each once, without loops; laid down, as every round reads them."""
    e = g.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("node_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("node_id"), F.col("a").alias("other"))))
    return cut(e.select(both.alias("x")).select("x.*"))


def placed(pairs: DataFrame, more: DataFrame) -> Tiles:
    """The nodes of symmetric pairs and of ``more`` in blocks, with their neighbours."""
    idx = tiles.cut(node_index(pairs.select("node_id").unionByName(more.select("node_id"))))
    at = lambda c, name: idx.select(F.col("node_id").alias(c), F.col("idx").alias(name))
    e = pairs.where("node_id < other").join(at("node_id", "a"), "node_id").join(at("other", "b"), "other")
    return tiles.blocked(tiles.laid(e.select("a", "b", F.lit(1.0).alias("w"))), idx)


def _starts(ways: dict) -> np.ndarray:
    """Where the edges of each node begin."""
    return np.flatnonzero(np.diff(ways["at"], prepend=-1))


def _gid(far: np.ndarray, blocks: int) -> np.ndarray:
    """Places in the index of what edges lead to."""
    return (far & (2**32 - 1)) * blocks + (far >> 32)


def in_main_component(nodes: DataFrame, pairs: DataFrame, terminals: DataFrame, t: Tiles | None = None) -> DataFrame:
    """The (set, node_id) rows in the graph's largest component (ties: the one of the smallest id): others can't be connected with these."""
    t = t or placed(pairs, nodes)
    n, blocks, width = t.n, t.blocks, t.width

    def begin(block, _):
        return {"label": np.arange(width) * blocks + block, "moved": np.ones(width, bool)}

    def give(s, ids):
        moved = s["moved"][ids]
        return (np.flatnonzero(moved).astype(np.int32), s["label"][ids][moved]) if moved.any() else None

    def take(_, x, messages):
        s, ways = x["state"][0], x["ways"][0]
        far = np.full(len(ways["far"]), NONE)
        for c, a, _ in tiles._bounds(ways["far"] >> 32):
            if c in messages:
                far[a + messages[c][0]] = messages[c][1]
        low, at = s["label"].copy(), _starts(ways)
        if len(at):
            rows = ways["at"][at]
            low[rows] = np.minimum(low[rows], np.minimum.reduceat(far[ways["pos"]], at))
        return {"label": low, "moved": low < s["label"]}

    d, moved = tiles.kept(t, tiles.stated(t, begin), lambda s: int(s["moved"].sum()))
    for _ in range(ROUNDS):
        d, moved = tiles.kept(t, tiles.turned(t, d, tiles.sent(t, d, give), take), lambda s: int(s["moved"].sum()), d)
        if not sum(moved):
            break
    if sum(moved):  # long chains: labels that jump over labels
        one = nodes.select(F.lit(0).alias("all"), "node_id").distinct()
        main = largest_component(one, pairs.select(F.col("node_id").alias("src"), F.col("other").alias("dst")), ["all"])
        return terminals.join(main.select("node_id"), "node_id", "left_semi").select("set", "node_id")

    def told(block, s):
        label = s["label"][: len(range(block, n, blocks))]
        yield pd.DataFrame({"idx": np.arange(len(label)) * blocks + block, "label": label})

    labels = tiles.rows_of(t, d, told, "idx long, label long")
    best = labels.groupBy("label").agg(F.count("*").alias("size")).agg(F.min_by("label", F.struct(-F.col("size"), "label")).alias("label"))  # one row
    main = labels.join(F.broadcast(best), "label").join(t.idx, "idx")
    return terminals.join(main.select("node_id"), "node_id", "left_semi").select("set", "node_id")


def _numbers(t: Tiles, rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(set, num), the rows as (num, idx, ...) and the number of sets."""
    sets, n = tiles.columns_of(rows, "set")
    return sets, tiles.laid(rows.join(sets, "set").join(t.idx, "node_id").drop("set", "node_id").distinct()), n


def _cells(t: Tiles, at: DataFrame, first: int, k: int) -> RDD:
    """States of owner, parent and hops (places and numbers, -1: none) of the sets ``first`` to ``first`` + k: a row for each node, a column for each set."""
    blocks, width = t.blocks, t.width

    def begin(block, x):
        r, s = x["rows"][0], {c: np.full((width, k), -1, np.int32 if t_n < 2**31 else np.int64) for c in ("owner", "parent")}
        s["hops"] = np.full((width, k), -1, np.int32)
        i, c = r["at"].astype(int), r["num"].astype(int) - first
        s["owner"][i, c], s["hops"][i, c] = i * blocks + block, 0
        return s | {"new": 1}

    t_n = t.n
    d, _ = tiles.kept(t, tiles.stated(t, begin, tiles.held(t, at.where(F.col("num").between(first, first + k - 1)), ["num"])), lambda s: 0)
    for i in count(1):

        def give(s, ids, i=i):
            front = s["hops"][ids] == i - 1
            return (np.packbits(front), s["owner"][ids][front]) if front.any() else None

        def take(_, x, messages, i=i):
            s, ways = x["state"][0], x["ways"][0]
            if not messages:
                return s | {"new": 0}
            far, new = np.full((len(ways["far"]), k), -1, s["owner"].dtype), 0
            for c, a, b in tiles._bounds(ways["far"] >> 32):
                if c in messages:
                    front = np.unpackbits(messages[c][0], count=(b - a) * k).reshape(-1, k).astype(bool)
                    far[a:b][front] = messages[c][1]
            owner, parent, hops, at = s["owner"].copy(), s["parent"].copy(), s["hops"].copy(), _starts(ways)
            rows, gid = ways["at"][at], _gid(ways["far"], blocks)
            for c in range(k):
                own = far[:, c].astype(np.int64)
                if (own < 0).all():
                    continue
                # the least owner, then the least parent of those
                best = np.minimum.reduceat(np.where(own >= 0, own, NONE)[ways["pos"]], at)
                size = np.diff(np.append(at, len(ways["at"])))
                near = np.minimum.reduceat(np.where(own[ways["pos"]] == np.repeat(best, size), gid[ways["pos"]], NONE), at)
                fit = (best < NONE) & (hops[rows, c] < 0)
                owner[rows[fit], c], parent[rows[fit], c], hops[rows[fit], c] = best[fit], near[fit], i
                new += int(fit.sum())
            return {"owner": owner, "parent": parent, "hops": hops, "new": new}

        d, new = tiles.kept(t, tiles.turned(t, d, tiles.sent(t, d, give), take), lambda s: s["new"], d)
        if not sum(new):
            return d


def _each(t: Tiles, n: int) -> list[tuple[int, int]]:
    """Sets that go together: (first, how many)."""
    return [(a, b - a) for a, b in tiles._few(t.idx, n, t.columns(2 * t.n))]


def _names(t: Tiles, column: str, of: DataFrame | None = None) -> DataFrame:
    """(column, column_id) of places; of those in ``of`` (idx) alone, if given, then sent to tasks if they are few."""
    d = t.idx.select(F.col("idx").alias(column), F.col("node_id").alias(f"{column}_id"))
    if of is None:
        return d
    d = d.join(of.select(F.col("idx").alias(column)).distinct(), column, "left_semi")
    return F.broadcast(d) if of.select("idx").distinct().count() <= NAMES else d


def distance_cells(pairs: DataFrame, terminals: DataFrame, parents: bool = True) -> DataFrame:
    """(set, node_id, owner, parent, hops): the nearest terminal of each set that reaches a node (ties: the smallest id), and the step towards it (ties likewise; not there without ``parents``).

    A terminal owns itself at 0 hops, without a parent. A node's owner is the least of the
    owners one hop nearer, so one round settles all nodes of one distance.
    """
    t = placed(pairs, terminals)
    sets, at, n = _numbers(t, terminals.select("set", "node_id"))
    names = tiles.packed(tiles._at(t, t.idx), ["at", "node_id"])
    names = tiles._laid(names, t.blocks, "names", lambda _, v: [x for p in v for _, x in sorted(zip(p["at"], p["node_id"]))])
    found = []
    for first, k in _each(t, n):

        def told(_, x, first=first, k=k):
            s, name = x
            name = np.array(name, object)
            for c in range(k):
                use = np.flatnonzero(s["hops"][: len(name), c] >= 0)
                yield pd.DataFrame({"num": first + c, "node_id": name[use], "owner": s["owner"][use, c], "parent": s["parent"][use, c], "hops": s["hops"][use, c]})

        both = tiles.met(_cells(t, at, first, k), names).mapPartitions(lambda it: ((b, ("told", (x["state"][0], x["names"][0]))) for b, x in it), True)
        found.append(cut(tiles.rows_of(t, both, told, "num long, node_id string, owner long, parent long, hops int")))
    d = reduce(DataFrame.unionByName, found) if found else t.idx.sparkSession.createDataFrame([], "num long, node_id string, owner long, parent long, hops int")
    d = d.join(sets, "num").join(_names(t, "owner", at), "owner")
    if not parents:
        return d.select("set", "node_id", F.col("owner_id").alias("owner"), "hops")
    return d.join(_names(t, "parent"), "parent", "left").select("set", "node_id", F.col("owner_id").alias("owner"), F.col("parent_id").alias("parent"), "hops")


def lightest(a, b, weight, u, v) -> tuple[np.ndarray, ...]:
    """Of links between the same two cells the lightest (ties: the smallest u, v); all arrays."""
    order = np.lexsort((v, u, weight, b, a))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    order = order[first]
    return tuple(x[order] for x in (a, b, weight, u, v))


def forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which links, one for two cells, are in the minimum spanning forest (ties by a, b)."""
    order = np.lexsort((b, a, weight))
    ends, at = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label, rank, chosen = np.arange(len(ends)), np.arange(len(a)), np.zeros(len(a), bool)
    while True:
        p, q = label[x[rank]], label[y[rank]]
        rank, p, q = rank[p != q], p[p != q], q[p != q]
        if not len(rank):
            return order[chosen]
        # links are in order: what is written last is the lightest of a part
        best, other = np.full(len(ends), -1), np.arange(len(ends))
        both, far = np.stack([p, q], 1).ravel()[::-1], np.stack([q, p], 1).ravel()[::-1]
        best[both], other[both] = np.repeat(rank, 2)[::-1], far
        chosen[best[best >= 0]] = True
        back = (other[other] == np.arange(len(ends))) & (np.arange(len(ends)) < other)
        other[back] = np.flatnonzero(back)
        while (other[other] != other).any():
            other = other[other]
        label = other[label]


LINK = "num long, a long, b long, weight long, u long, v long"


def _links(t: Tiles, d: RDD, first: int, k: int) -> DataFrame:
    """(num, a, b, weight, u, v), places: the minimum spanning forest of the lightest ways between cells that touch.

    A link that is the heaviest of a circle in a part of the links is not in the whole forest, so blocks
    tell their forests alone, and tasks take forests of these, until a task has a set's.
    """
    blocks = t.blocks

    def give(s, ids):
        hops = s["hops"][ids]
        return s["owner"][ids], hops.astype(np.min_scalar_type(-1 - int(hops.max(initial=0))))

    def take(block, x, messages):
        s, ways = x["state"][0], x["ways"][0]
        owner, hops = (np.full((len(ways["far"]), k), -1, s[c].dtype) for c in ("owner", "hops"))
        for c, a, b in tiles._bounds(ways["far"] >> 32):
            owner[a:b], hops[a:b] = messages[c]
        gid, out = _gid(ways["far"], blocks), []
        for c in range(k):
            a, b = s["owner"][ways["at"], c].astype(np.int64), owner[ways["pos"], c].astype(np.int64)
            use = np.flatnonzero((a >= 0) & (a < b))  # each edge comes in this order once
            at, pos = ways["at"][use], ways["pos"][use]
            link = lightest(a[use], b[use], (s["hops"][at, c].astype(np.int64) + hops[pos, c] + 1), at.astype(np.int64) * blocks + block, gid[pos])
            keep = forest(*link[:3])
            out.append(tuple(v[keep] for v in link))
        return out

    def told(_, s):
        for c, link in enumerate(s):
            yield pd.DataFrame({"num": first + c} | dict(zip(("a", "b", "weight", "u", "v"), link)))

    links = tiles.laid(tiles.rows_of(t, tiles.turned(t, d, tiles.sent(t, d, give), take), told, LINK))

    def few(pdf: pd.DataFrame) -> pd.DataFrame:
        link = lightest(*(pdf[c].to_numpy() for c in ("a", "b", "weight", "u", "v")))
        keep = forest(*link[:3])
        return pd.DataFrame({"num": pdf["num"].iloc[0]} | {c: v[keep] for c, v in zip(("a", "b", "weight", "u", "v"), link)})

    while True:
        most, all_ = links.groupBy("num").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
        parts = math.ceil((most or 0) / LINKS)
        if parts <= 1:
            return tiles.laid(links.groupBy("num").applyInPandas(few, LINK))
        less = tiles.laid(links.withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(parts))).groupBy("num", "part").applyInPandas(few, LINK))
        if less.count() > 0.75 * all_:  # more cells than a task takes
            best = links.groupBy("num", "a", "b").agg(F.min(F.struct("weight", "u", "v")).alias("x"))
            return spanning_links(best.select(F.col("num").alias("set"), "a", "b", "x.*")).withColumnRenamed("set", "num")
        links = less


def spanning(pairs: DataFrame, terminals: DataFrame) -> DataFrame:
    """(set, weight) of each link in the minimum spanning forests of sets' terminals, over the lightest ways between cells that touch."""
    t = placed(pairs, terminals)
    sets, at, n = _numbers(t, terminals.select("set", "node_id"))
    links = [_links(t, _cells(t, at, first, k), first, k) for first, k in _each(t, n)]
    d = reduce(DataFrame.unionByName, links) if links else t.idx.sparkSession.createDataFrame([], LINK)
    return d.join(sets, "num").select("set", "weight")


def spanning_links(links: DataFrame) -> DataFrame:
    """The rows of (set, a, b, weight, ...) in each set's minimum spanning forest (ties by a, b).

    Each round every part takes its lightest link to another part, and the parts so linked
    become one: their number halves at least.
    """
    links = cut(links)
    ends = links.select("set", F.col("a").alias("node")).unionByName(links.select("set", F.col("b").alias("node"))).distinct()
    label = cut(ends.withColumn("part", F.concat_ws("\x01", F.col("set").cast("string"), "node")))
    live, chosen = links, links.limit(0)
    while True:
        at = lambda end: label.select("set", F.col("node").alias(end), F.col("part").alias(f"p{end}"))
        live = fresh(live.drop("pa", "pb").join(at("a"), ["set", "a"]).join(at("b"), ["set", "b"]).where("pa <> pb"))
        if live.isEmpty():
            return chosen.select(*links.columns)
        key = F.struct("weight", "a", "b")
        best = live.select("pa", key.alias("k")).unionByName(live.select(F.col("pb").alias("pa"), key.alias("k"))).groupBy("pa").agg(F.min("k").alias("k"))
        picked = fresh(live.join(best.select("pa", "k.*").withColumnRenamed("pa", "p").distinct(), ["weight", "a", "b"]).where("p = pa OR p = pb").drop("p").distinct())
        chosen = cut(chosen.unionByName(picked.select(*links.columns)))
        parts = label.select(F.col("part").alias("node_id")).distinct()
        joined = components(parts, picked.select(F.col("pa").alias("src"), F.col("pb").alias("dst")))
        label = fresh(label.join(joined.withColumnRenamed("node_id", "part"), "part").select("set", "node", F.col("component").alias("part")))


def _traced(t: Tiles, d: RDD, front: DataFrame, first: int) -> list[RDD]:
    """(num, place, place of the step towards the owner) on the ways of (num, idx) to their owners: frames by block, round after round."""
    blocks, out = t.blocks, []
    ahead = tiles.packed(tiles._at(t, front), ["num", "at"]).partitionBy(blocks, tiles.home).mapValues(lambda v: ("front", v))
    while True:

        def step(it):
            for block, x in it:
                if "front" not in x:
                    continue
                s, (num, at) = x["state"][0], (np.concatenate([f[c] for f in x["front"]]).astype(np.int64) for c in ("num", "at"))
                num, at = np.unique(np.stack([num, at]), axis=1)
                up = s["parent"][at, num - first].astype(np.int64)
                if (up >= 0).any():
                    yield block, (num[up >= 0], at[up >= 0] * blocks + block, up[up >= 0])

        rows = tiles.met(d, ahead).mapPartitions(step, True).persist(StorageLevel.DISK_ONLY)
        rows.checkpoint()
        if not rows.count():
            return out
        out.append(rows)

        def on(it):
            for _, (num, _, up) in it:
                for k in np.unique(up % blocks):
                    mine = up % blocks == k
                    yield int(k), ("front", {"num": num[mine], "at": up[mine] // blocks})

        ahead = rows.mapPartitions(on).partitionBy(blocks, tiles.home)


def steiner_forest(pairs: DataFrame, terminals: DataFrame, t: Tiles | None = None) -> DataFrame:
    """(set, src, dst) with src < dst: for each set a tree over its terminals, of at most twice the least number of edges; one for each component of the graph that has some.

    Cells around terminals, a minimum spanning forest over the lightest ways between cells
    that touch, and the ways traced back to their owners (Mehlhorn, 1988). Within a cell the
    ways are one shortest-path tree, so the union has no cycle and no loose end.
    """
    t = t or placed(pairs, terminals)
    sets, at, n = _numbers(t, terminals.select("set", "node_id"))
    spark = t.idx.sparkSession
    found = [spark.createDataFrame([], "num long, a long, b long")]
    for first, k in _each(t, n):
        d = _cells(t, at, first, k)
        links = _links(t, d, first, k)
        found.append(links.select("num", F.col("u").alias("a"), F.col("v").alias("b")))
        front = links.select("num", F.explode(F.array("u", "v")).alias("idx")).distinct()
        if ways := _traced(t, d, front, first):
            rows = spark.sparkContext.union(ways).map(lambda x: (x[0], bytearray(np.stack(x[1][1:]).tobytes()), bytearray(x[1][0].tobytes())))

            def told(pdfs):
                for pdf in pdfs:
                    for x, num in zip(pdf["x"], pdf["num"]):
                        x = np.frombuffer(x, np.int64).reshape(2, -1)
                        yield pd.DataFrame({"num": np.frombuffer(num, np.int64), "a": x[0], "b": x[1]})

            found.append(spark.createDataFrame(rows, "block int, x binary, num binary", verifySchema=False).mapInPandas(told, "num long, a long, b long"))
    e = reduce(DataFrame.unionByName, found).select("num", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # places are in order of ids
    return e.join(sets, "num").join(_names(t, "a"), "a").join(_names(t, "b"), "b").select("set", F.col("a_id").alias("src"), F.col("b_id").alias("dst"))


def steiner_nodes(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """(set, node_id, is_seed) of (set, src, dst) trees; a terminal that nothing connects stays, alone."""
    ends = edges.select("set", F.col("src").alias("node_id")).unionByName(edges.select("set", F.col("dst").alias("node_id")))
    both = ends.withColumn("is_seed", F.lit(False)).unionByName(terminals.select("set", "node_id", F.lit(True).alias("is_seed")))
    return both.groupBy("set", "node_id").agg(F.max("is_seed").alias("is_seed"))


#: Share of a set's total that seeds are to cover, and the least value of a seed as a share of the largest.
COVERAGE, DROPOFF = 0.30, 0.20


def connected_seeds(pairs: DataFrame, values: DataFrame, coverage: float = COVERAGE, dropoff: float = DROPOFF, hops: int = 2) -> DataFrame:
    """(set, node_id, value, covered): seeds of (set, node_id, value >= 0), from high to low values (ties by id).

    The highest candidate is a seed; each further one is if a seed before it is within
    ``hops``, until the seeds' values reach ``coverage`` of the total or a value is under
    ``dropoff`` of the highest. ``covered`` is the share of the total up to the seed.
    Candidates that no pair holds only count in the total.

    A candidate is a seed just if a chain of candidates leads to it, each after the one
    before and within reach of it. So all chains grow at once: a node keeps, for each
    number of hops left, the earliest seed that reaches it; what gets earlier is passed
    on, and a candidate that an earlier one reaches sets out itself. No pairs of
    candidates are made.
    """
    t = placed(pairs, pairs.limit(0))
    here = values.join(t.idx, "node_id").select("set", "node_id", "idx", "value")
    top = here.groupBy("set").agg(F.max("value").alias("top"))
    able = here.join(top, "set").where(F.col("value") >= dropoff * F.col("top")).drop("top")
    sets, n = tiles.columns_of(able, "set")
    # places in (set, descending value, id) are the order
    able = tiles.laid(numbered(able.join(sets, "set"), [F.asc("num"), F.desc("value"), F.asc("node_id")], "order"))
    found = [_seeds(t, able, first, k, hops) for first, k in [(a, b - a) for a, b in tiles._few(sets, n, t.columns((hops + 1) * t.n))]]
    schema = "num long, order long"
    seeds = reduce(DataFrame.unionByName, found) if found else t.idx.sparkSession.createDataFrame([], schema)
    seeds = able.join(seeds, ["num", "order"], "left_semi").select("set", "node_id", "value", "order")
    total = values.groupBy("set").agg(F.sum("value").alias("total"))
    so_far = Window.partitionBy("set").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    # a set's seeds are in one window, ids and values alone
    d = seeds.join(total, "set").withColumn("covered", F.sum("value").over(so_far) / F.col("total"))
    return d.where((F.col("covered") - F.col("value") / F.col("total") < coverage) & (F.col("total") > 0)).select("set", "node_id", "value", "covered")


def _seeds(t: Tiles, able: DataFrame, first: int, k: int, hops: int) -> DataFrame:
    """(num, order) of the seeds among (num, idx, order), of the sets ``first`` to ``first`` + k."""
    mine, width = able.where(F.col("num").between(first, first + k - 1)), t.width
    start = {int(r["num"]) - first: int(r["o"]) for r in mine.groupBy("num").agg(F.min("order").alias("o")).collect()}  # a row for each set

    def begin(_, x):
        r, order = x["rows"][0], np.full((width, k), NONE)
        order[r["at"].astype(int), r["num"].astype(int) - first] = r["order"]
        seed = order == np.array([start.get(c, -1) for c in range(k)])
        by = np.full((width, k, hops + 1), NONE)
        by[:, :, hops] = np.where(seed, order, NONE)
        return {"order": order, "seed": seed, "by": by, "moved": by < NONE}

    def give(s, ids):
        moved = s["moved"][ids][:, :, 1:]
        return (np.packbits(moved), s["by"][ids][:, :, 1:][moved]) if moved.any() else None

    def take(_, x, messages):
        s, ways = x["state"][0], x["ways"][0]
        if not messages:
            return s | {"moved": np.zeros_like(s["moved"])}
        far = np.full((len(ways["far"]), k, hops), NONE)
        for c, a, b in tiles._bounds(ways["far"] >> 32):
            if c in messages:
                moved = np.unpackbits(messages[c][0], count=(b - a) * k * hops).reshape(-1, k, hops).astype(bool)
                far[a:b][moved] = messages[c][1]
        by, at = s["by"].copy(), _starts(ways)
        rows = ways["at"][at]
        for c in range(k):
            for left in range(hops):
                if (far[:, c, left] < NONE).any():
                    by[rows, c, left] = np.minimum(by[rows, c, left], np.minimum.reduceat(far[ways["pos"], c, left], at))
        new = (s["order"] < NONE) & ~s["seed"] & (by.min(2) < s["order"])
        by[:, :, hops] = np.minimum(by[:, :, hops], np.where(new, s["order"], NONE))
        return {"order": s["order"], "seed": s["seed"] | new, "by": by, "moved": by < s["by"]}

    d, moved = tiles.kept(t, tiles.stated(t, begin, tiles.held(t, mine.select("num", "idx", "order"), ["num", "order"])), lambda s: int(s["moved"][:, :, 1:].sum()))
    while sum(moved):
        d, moved = tiles.kept(t, tiles.turned(t, d, tiles.sent(t, d, give), take), lambda s: int(s["moved"][:, :, 1:].sum()), d)

    def told(_, s):
        for c in range(k):
            yield pd.DataFrame({"num": first + c, "order": s["order"][s["seed"][:, c], c]})

    return tiles.laid(tiles.rows_of(t, d, told, "num long, order long"))
