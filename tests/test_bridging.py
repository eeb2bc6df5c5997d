import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import bridging as br

PAIR, TERM = "node_id string, other string", "set string, node_id string"


def both(edges):
    return sorted({(a, b) for a, b in edges} | {(b, a) for a, b in edges})


def random_graph(seed, n=9, p=0.3):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(n)]
    return nodes, [(a, b) for a, b in itertools.combinations(nodes, 2) if rng.random() < p], rng


def distances(edges, start):
    near = {}
    for a, b in both(edges):
        near.setdefault(a, []).append(b)
    d, front = {start: 0}, [start]
    while front:
        nxt = []
        for a in front:
            for b in near.get(a, ()):
                if b not in d:
                    d[b] = d[a] + 1
                    nxt.append(b)
        front = nxt
    return d


def connected(nodes, edges, members):
    inside = [(a, b) for a, b in edges if a in nodes and b in nodes]
    return set(members) <= set(distances(inside, members[0]))


def least_tree(nodes, edges, terminals):
    rest = [n for n in nodes if n not in terminals]
    for k in range(len(rest) + 1):
        for more in itertools.combinations(rest, k):
            if connected(set(terminals) | set(more), edges, terminals):
                return len(terminals) + k - 1


def test_cells_are_the_nearest_terminals(spark):
    rows, pairs, want = [], [], {}
    for seed in range(4):
        nodes, edges, rng = random_graph(seed, 12, 0.2)
        tag = lambda x: f"{seed}{x}"  # noqa: E731, B023
        ts = rng.sample(nodes, 3)
        pairs += [(tag(a), tag(b)) for a, b in both(edges)]
        rows += [(str(seed), tag(t)) for t in ts]
        for t in ts:
            for n, d in distances(edges, t).items():
                key = (str(seed), tag(n))
                want[key] = min(want.get(key, (99, "")), (d, tag(t)))
    got = br.distance_cells(spark.createDataFrame(pairs, PAIR), spark.createDataFrame(rows, TERM)).collect()
    assert {(r["set"], r["node_id"]): (r["hops"], r["owner"]) for r in got} == want
    by = {(r["set"], r["node_id"]): r for r in got}
    for r in got:
        if r["hops"]:
            p = by[r["set"], r["parent"]]
            assert (p["hops"], p["owner"]) == (r["hops"] - 1, r["owner"]) and (r["parent"], r["node_id"]) in pairs


def test_trees_span_and_cost_twice_the_least_at_most(spark):
    rows, pairs, cases = [], [], []
    for seed in range(12):
        nodes, edges, rng = random_graph(100 + seed)
        ts = rng.sample(nodes, 4)
        if not connected(set(nodes), edges, ts):
            continue
        tag = lambda x: f"{seed}{x}"  # noqa: E731, B023
        cases.append((str(seed), [tag(n) for n in nodes], [(tag(a), tag(b)) for a, b in edges], [tag(t) for t in ts]))
        pairs += both(cases[-1][2])
        rows += [(str(seed), tag(t)) for t in ts] * 2  # repeated rows are one terminal
    assert len(cases) > 5
    got = br.steiner_forest(spark.createDataFrame(pairs, PAIR), spark.createDataFrame(rows, TERM)).collect()
    for key, nodes, edges, ts in cases:
        tree = [(r["src"], r["dst"]) for r in got if r["set"] == key]
        members = {x for e in tree for x in e}
        assert set(tree) <= {tuple(sorted(e)) for e in edges}
        assert set(ts) <= members and connected(members, tree, ts) and len(tree) == len(members) - 1
        assert len(tree) <= 2 * least_tree(nodes, edges, ts)
        degree = {m: sum(m in e for e in tree) for m in members}
        assert all(m in ts for m in members if degree[m] == 1)  # no loose end


def test_trees_of_parts_lone_terminals_and_no_terminals(spark):
    pairs = spark.createDataFrame(both([("a", "b"), ("b", "c"), ("d", "e")]), PAIR)
    t = spark.createDataFrame([("s", x) for x in "acde"] + [("t", "b"), ("t", "z")], TERM)
    f = br.steiner_forest(pairs, t)
    assert sorted(map(tuple, f.select("set", "src", "dst").collect())) == [("s", "a", "b"), ("s", "b", "c"), ("s", "d", "e")]
    n = {(r["set"], r["node_id"]): r["is_seed"] for r in br.steiner_nodes(f, t).collect()}
    assert n == {("s", "a"): True, ("s", "b"): False, ("s", "c"): True, ("s", "d"): True, ("s", "e"): True, ("t", "b"): True, ("t", "z"): True}
    assert br.steiner_forest(pairs, t.limit(0)).collect() == []
    nodes = pairs.select("node_id").distinct()
    assert sorted(map(tuple, br.in_main_component(nodes, pairs, t).collect())) == [("s", "a"), ("s", "c"), ("t", "b")]


def in_turn(edges, values, coverage, dropoff, hops):
    """The rule one candidate after another."""
    held = {x for e in edges for x in e}
    order = sorted(((-v, n) for n, v in values.items() if n in held))
    total, chosen, covered = sum(values.values()), [], 0.0
    if not order or total <= 0:
        return []
    within = set()
    for low, n in order:
        if chosen and (covered / total >= coverage or -low < dropoff * -order[0][0]):
            break
        if not chosen or n in within:
            chosen.append(n)
            covered += -low
            within |= {x for x, d in distances(edges, n).items() if d <= hops}
    return chosen


@pytest.mark.parametrize("coverage,dropoff,hops", [(0.3, 0.2, 2), (2.0, 0.0, 1), (0.7, 0.05, 3)])
def test_seeds_as_in_turn(spark, coverage, dropoff, hops):
    rows, pairs, want = [], [], set()
    for seed in range(15):
        nodes, edges, rng = random_graph(200 + seed, 24, 0.07)
        values = {n: float(rng.randrange(1, 12)) for n in rng.sample(nodes, 18)}
        values["away"] = 7.0
        pairs += [(f"{seed}{a}", f"{seed}{b}") for a, b in both(edges)]
        rows += [(str(seed), f"{seed}{n}", v) for n, v in values.items()]
        # ids compare with their tag as without it
        want |= {(str(seed), f"{seed}{n}") for n in in_turn(edges, values, coverage, dropoff, hops)}
    got = br.connected_seeds(spark.createDataFrame(pairs, PAIR), spark.createDataFrame(rows, "set string, node_id string, value double"), coverage, dropoff, hops).collect()
    assert {(r["set"], r["node_id"]) for r in got} == want and len(got) == len(want)
    assert br.connected_seeds(spark.createDataFrame(pairs, PAIR), spark.createDataFrame([], "set string, node_id string, value double")).collect() == []


def test_each_cell_is_laid_down_once(spark, monkeypatch):
    laid, cut = [], br.cut
    monkeypatch.setattr(br, "cut", lambda d: (r := cut(d), laid.append(r.count()))[0])
    pairs = spark.createDataFrame(both([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]), PAIR)
    got = br.distance_cells(pairs, spark.createDataFrame([("s", "a"), ("t", "c")], TERM)).collect()
    assert len(got) == 10 and sum(laid) == 10


def test_estimates_of_size_do_not_pile_up(spark):
    from strandline.operators import iterate

    d = spark.range(3).withColumnRenamed("id", "node_id")
    for _ in range(6):
        d = iterate.fresh(d.join(d.withColumnRenamed("node_id", "x"), F.col("node_id") == F.col("x")).select("node_id"))
    assert d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 200
