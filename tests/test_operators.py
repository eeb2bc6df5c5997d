"""Small cases worked by hand, and numpy or the standard library where SQL can't say it."""

import difflib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import lipids, names, special
from strandline.graph import Graph, upsert
from strandline.operators import axes, currency, enrichment, inference, iterate, models, ranking, resolve, scoring, stats
from strandline.plans.build import Build, verify
from strandline.sources import annotate, graphs, tables

NODE = "node_id string, node_type string, name string, reversible boolean, is_currency boolean, compartment string, pathways array<string>"


@pytest.fixture(scope="module")
def chain(spark):
    """A -> R1 -> B -> R2 -> C, R2 reversible, ATP a currency substrate of both, G1 an enzyme of R1."""
    nodes = [(n, "metabolite", n.lower(), False, n == "ATP", None, None) for n in ("A", "B", "C", "ATP")]
    nodes += [("R1", "reaction", "one", False, False, None, ["p", "q"]), ("R2", "reaction", "two", True, False, None, ["p"]), ("G1", "gene", "g", False, False, None, None)]
    edges = [("A", "R1", "substrate"), ("R1", "B", "product"), ("B", "R2", "substrate"), ("R2", "C", "product"), ("ATP", "R1", "substrate"), ("ATP", "R2", "substrate"), ("G1", "R1", "catalysis")]
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "src string, dst string, rel string"))


@pytest.fixture(scope="module")
def seen(spark):
    return spark.createDataFrame([("A", -1.0, 1.0), ("B", 2.0, 0.5), ("G1", 1.0, 1.0), ("ATP", 9.0, 1.0)], "node_id string, effect_size double, confidence double")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_two_reactions(chain, seen):
    got = {r["reaction_id"]: r for r in scoring.score_reactions(chain, seen).collect()}
    assert got["R1"]["score"] == pytest.approx(1.5629488, abs=1e-6) and got["R1"]["direction"] == 1 and got["R1"]["evidence_count"] == 3
    assert got["R2"]["score"] == pytest.approx(0.70710678, abs=1e-6) and got["R2"]["direction"] == -1
    with_atp = {r["reaction_id"]: r["evidence_count"] for r in scoring.score_reactions(chain, seen, currency_weight=0.5).collect()}
    assert with_atp == {"R1": 4, "R2": 2}
    assert scoring.score_reactions(chain, seen.limit(0)).collect() == []


def test_gate(chain, spark):
    for effect, want in ((-0.25, 0.65), (-0.6, 0.3), (2.0, 1.0)):
        e = spark.createDataFrame([("G1", effect, 1.0)], "node_id string, effect_size double, confidence double")
        assert scoring.enzyme_gate(chain, e).first()["gate"] == pytest.approx(want)
    s = spark.createDataFrame([("R9", 2.0)], "reaction_id string, score double")
    assert scoring.apply_gate(s, scoring.enzyme_gate(chain, e)).first()["gated_score"] == 2.0


def test_upsert_overwrites_attribute_by_attribute(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "node_id string, name string, n int")
    new = spark.createDataFrame([("a", None, 5, 1), ("a", "z", None, 2), ("c", "w", 3, 1)], "node_id string, name string, n int, load_seq int")
    assert rows(upsert(old, new, ["node_id"]), "node_id", "name", "n") == [("a", "z", 5), ("b", "y", 2), ("c", "w", 3)]


def test_compartments(spark):
    nodes = spark.createDataFrame([("m@c", "metabolite", None, None), ("m@e", "metabolite", None, "CHEBI:1"), ("r", "reaction", None, None)], "node_id string, node_type string, compartment string, chebi_id string")
    edges = spark.createDataFrame([("m@c", "m@e", "transport", 0.5), ("m@c", "r", "substrate", 0.2), ("m@e", "r", "substrate", 0.9)], "src string, dst string, rel string, confidence double")
    g = Graph(nodes, edges)
    assert rows(g.compartment_summary(), "compartment", "n") == [("c", 1), ("e", 1)]
    c = g.collapse_compartments()
    assert rows(c.nodes, "node_id", "chebi_id") == [("m", "CHEBI:1"), ("r", None)] and rows(c.edges, "src", "dst", "confidence") == [("m", "r", 0.9)]
    assert rows(g.with_compartments().same_compartment("e").nodes, "node_id") == [("m@e",), ("r",)]


def test_adjustment(spark):
    p = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.005), (4, None)], "i int, p_value double")
    got = {r["i"]: r["fdr"] for r in stats.bh(p).collect()}
    assert [got[i] for i in range(4)] == pytest.approx([0.02, 0.04, 0.04, 0.02]) and got[4] is None


def test_tails():
    assert special.hypergeom_sf([2], [10], [4], [3])[0] == pytest.approx(1 / 3)
    assert special.normal_isf(0.025) == pytest.approx(1.959964, abs=1e-6)
    assert special.t_sf2(np.array([2.228139]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-6)
    assert special.t_sf2(np.array([1.959964]), np.array([math.inf]))[0] == pytest.approx(0.05, abs=1e-6)
    assert special.chi2_sf(np.array([3.841459, 18.307]), np.array([1.0, 10.0])) == pytest.approx([0.05, 0.05], abs=1e-5)
    x = np.array([0.1, 0.5, 1.0, 3.3, 50.0])
    assert special.gammaln(x) == pytest.approx([math.lgamma(v) for v in x])
    assert special.trigamma(special.inverse_trigamma(0.7)) == pytest.approx(0.7)
    assert special.digamma(1.0) == pytest.approx(-0.5772156649)
    assert stats.stouffer([0.05, 0.05]) == pytest.approx(float(special.normal_sf(np.array([special.normal_isf(0.05) * math.sqrt(2)]))[0]))


def test_preranked(spark):
    m = spark.createDataFrame([("s", "n1"), ("s", "n2")], "pathway_id string, node_id string")
    r = spark.createDataFrame([("n1", 3.0), ("n2", 1.0), ("n3", 0.5), ("n4", 0.4), ("n5", 0.1)], "node_id string, score double")
    got = enrichment.preranked(m, r, 2).first()
    assert got["es"] == pytest.approx(1.0) and got["leading_edge"] == "n1,n2"


def test_collapse(chain):
    got = iterate.collapse_graph(Graph(chain.nodes.where("node_id <> 'ATP'"), chain.edges.where("src <> 'ATP'")), ["metabolite"])
    assert rows(got, "src", "dst") == [("A", "B"), ("B", "C")] and all(r["via"] == ["metabolite", "reaction"] for r in got.collect())


def test_components_and_paths(spark):
    n = spark.createDataFrame([(str(i).zfill(3),) for i in range(60)], "node_id string")
    e = spark.createDataFrame([(str(i).zfill(3), str(i + 1).zfill(3)) for i in range(40) if i != 19] + [("050", "050")], "src string, dst string")
    got = {r["node_id"]: r["component"] for r in iterate.components(n, e).collect()}
    assert got == {str(i).zfill(3): ("000" if i < 20 else "020" if i < 41 else str(i).zfill(3)) for i in range(60)}
    g = Graph(n.withColumn("node_type", F.lit("x")), e.withColumn("rel", F.lit("y")))
    p = iterate.shortest_to(g, spark.createDataFrame([("003",), ("050",)], "node_id string"), spark.createDataFrame([("006",), ("000",)], "node_id string"))
    assert [(r["start"], r["path"]) for r in p.collect()] == [("003", ["003", "002", "001", "000"])]


def test_pagerank_against_numpy(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("d", "a")]
    n = ["a", "b", "c", "d", "z"]
    got = {r[0]: r[1] for r in iterate.pagerank(spark.createDataFrame([(x,) for x in n], "node_id string"), spark.createDataFrame(e, "src string, dst string"), tol=1e-9).collect()}
    m = np.zeros((5, 5))
    for a, b in e:
        m[n.index(b), n.index(a)] = 1 / sum(x[0] == a for x in e)
    m[:, 4] = 1 / 5
    r = np.full(5, 0.2)
    for _ in range(200):
        r = 0.15 / 5 + 0.85 * m @ r
    assert [got[x] for x in n] == pytest.approx(r, abs=1e-7)


def test_inference_against_dense(spark):
    ids = ["a", "b", "c", "d"]
    g = Graph(spark.createDataFrame([(i,) for i in ids], "node_id string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string"))
    lap = np.array([[1, -1, 0, 0], [-1, 2, -1, 0], [0, -1, 2, -1], [0, 0, -1, 1]], float)
    x = spark.createDataFrame([("p", "m", "b", 2.0), ("q", "m", "a", -1.0), ("q", "m", "d", 3.0)], "patient_id string, modality string, node_id string, value double")
    # two features of p lie on b
    x = x.unionByName(spark.createDataFrame([("p", "m", "b", 0.5), ("p", "k", "b", 1.0)], x.schema))
    got = {(r["patient_id"], r["node_id"]): r for r in inference.solve_map(g, x, {"m": 0.5, "k": 2.0}, smooth=0.7).collect()}
    for p, rhs, anchor in (("p", {"b": 2.5 * 4 + 0.25}, {"b": 8.25}), ("q", {"a": -4.0, "d": 12.0}, {"a": 4.0, "d": 4.0})):
        want = np.linalg.solve(np.diag([anchor.get(i, 0.0) + 1e-6 for i in ids]) + 0.7 * lap, [rhs.get(i, 0.0) for i in ids])
        assert [got[p, i]["f"] for i in ids] == pytest.approx(want, abs=1e-6) and got[p, "a"]["smoothness"] == pytest.approx(want @ lap @ want, abs=1e-6)
    a, _ = inference.rows(g)
    v, w = np.linalg.eigh(lap)
    b = np.array([[1.0], [0.0], [2.0], [0.0]])
    assert inference.heat(a, a.degree, b, 1.3) == pytest.approx(w @ np.diag(np.exp(-1.3 * v)) @ w.T @ b)


@pytest.fixture(scope="module")
def mixed_graph(spark):
    """Substrates, products, enzymes, a currency metabolite, a disease and a far node, with stoichiometry."""
    nodes = [(n, "metabolite", n, False, n == "w", None, None) for n in ("a", "b", "c", "w", "far", "end")] + [(n, "reaction", n, False, False, None, None) for n in ("r", "s", "t")]
    nodes += [("g", "gene", "g", False, False, None, None), ("d", "disease", "d", False, False, None, None), ("o", "phenotype", "o", False, False, None, None)]
    edges = [("a", "r", "substrate", 2.0), ("w", "r", "substrate", 1.0), ("r", "b", "product", 0.0), ("b", "s", "substrate", 1.0), ("s", "c", "product", 3.0), ("g", "r", "catalysis", None)]
    edges += [("d", "g", "disease_gene", None), ("o", "d", "phenotype_disease", None), ("c", "t", "substrate", 1.0), ("t", "far", "product", 1.0), ("c", "s", "modifier", None), ("o", "end", "unknown", None)]
    g = Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "src string, dst string, rel string, stoichiometry double"))
    rec = [("x", "metabolomics", "a", -1.5, 0.8), ("x", "metabolomics", "a", 0.5, 1.0), ("x", "metabolomics", "b", 2.0, 0.5), ("x", "transcriptomics", "g", 3.0, 1.0), ("x", "metabolomics", "w", 5.0, 1.0)]
    return g, [n[:2] for n in nodes], edges, rec, spark.createDataFrame(rec, "sample_id string, assay string, node_id string, effect_size double, confidence double")


def test_laplacian_against_dense(spark, mixed_graph):
    g, nodes, edges, rec, e = mixed_graph
    at = {n: i for i, (n, _) in enumerate(nodes)}
    for cap in ({}, {"g": 0.3}):
        adj = np.zeros((len(at), len(at)))
        for u, v, rel, amount in edges:
            if "w" in (u, v) or rel in ("unknown", "phenotype_disease"):
                continue
            w = (amount or 1.0) if rel in ("substrate", "product") else cap.get(u, cap.get(v, 1.0))
            adj[at[u], at[v]] += w / 2
            adj[at[v], at[u]] += w / 2
        root = 1 / np.sqrt(np.where(adj.sum(1) > 0, adj.sum(1), 1))
        y = np.zeros(len(at))
        for kind in ("metabolite", "gene"):
            part = np.zeros(len(at))
            for _, _, n, x, c in rec:
                part[at[n]] += x * c if dict(nodes)[n] == kind else 0
            y += part / np.linalg.norm(part)
        x = np.linalg.solve(2 * np.eye(len(at)) - root[:, None] * adj * root, y)
        capacity = spark.createDataFrame(list(cap.items()), "node_id string, capacity double") if cap else None
        got = {r["node_id"]: r for r in inference.laplacian(g, e, tol=1e-12, capacity=capacity).collect()}
        up = 0.95 / (1 + np.exp(-2 * x))
        assert all((got[n]["score"], got[n]["p_up"], got[n]["p_normal"], got[n]["p_down"]) == pytest.approx((x[i], up[i], 0.05, 0.95 - up[i]), abs=1e-8) for n, i in at.items())


def plain_propagation(nodes, edges, rec, hops, rounds):
    """Message by message, with products and no logarithms."""
    theta = {"substrate": (1.0, -1.0), "product": (1.0, 1.0), "modifier": (0.3, 1.0), "disease_gene": (1.2, 1.0), "phenotype_disease": (1.5, 1.0)}
    kind, sign = dict(nodes), np.array([-1.0, 0.0, 1.0])
    live = {r[2] for r in rec}
    for _ in range(hops):
        live |= {v for u, v, *_ in edges if u in live} | {u for u, v, *_ in edges if v in live}
    live -= {"w"}
    unary = {}
    for n in live:
        b = 4.0 if kind[n] in ("disease", "phenotype") else 1.5
        unary[n] = np.array([1, b, 1]) / (2 + b)
    for _, assay, n, x, c in rec:
        if n in live:
            if kind[n] in ("disease", "phenotype"):
                like = np.array([0.025, 0.025, 0.95])
            else:
                z = (x * c - sign) / max({"transcriptomics": 2.0}.get(assay, 1.0) / c, 0.1)
                like = np.maximum(np.exp(-0.5 * z * z + 0.5 * (z * z).min()), 1e-30)
            unary[n] = unary[n] * like / (unary[n] * like).sum()
    both = [(u, v, t * s) for u, v, rel, _ in edges if u in live and v in live for t, s in [theta.get(rel, (0, 1))] if t]
    both += [(v, u, x) for u, v, x in both]
    half = len(both) // 2
    msg = [np.ones(3) / 3 for _ in both]
    for _ in range(rounds):
        new = []
        for k, (u, v, x) in enumerate(both):
            back = (k + half) % len(both)
            f = unary[u] * np.prod([msg[j] for j, (_, w, _) in enumerate(both) if w == u and j != back], axis=0)
            m = np.exp(x * np.outer(sign, sign)).T @ f
            new.append(m / m.sum())
        msg = [0.5 * a + 0.5 * b for a, b in zip(msg, new)]
    out = {n: unary[n] * np.prod([msg[j] for j, (_, w, _) in enumerate(both) if w == n], axis=0) for n in live}
    return {n: x / x.sum() for n, x in out.items()}


@pytest.mark.parametrize("hops,more", [(3, []), (1, []), (2, [("x", "clinical", "d", 1.0, 1.0)])])
def test_belief_propagation_against_messages(spark, mixed_graph, hops, more):
    g, nodes, edges, rec, e = mixed_graph
    e = e.unionByName(spark.createDataFrame(more, e.schema)) if more else e
    rows_ = inference.belief_propagation(g, e, hops=hops, rounds=7, tol=0).collect()
    got = {r["node_id"]: (r["p_down"], r["p_normal"], r["p_up"]) for r in rows_}
    want = plain_propagation(nodes, edges, rec + more, hops, 7)
    assert set(got) == set(want) and all(got[n] == pytest.approx(want[n], abs=1e-9) for n in want)
    assert {(r["rounds"], r["converged"]) for r in rows_} == {(7, False)}


def test_belief_propagation_on_a_tree_is_exact(spark):
    kinds = [("a", "metabolite"), ("b", "reaction"), ("c", "metabolite"), ("n", "metabolite")]
    g = Graph(spark.createDataFrame(kinds, "node_id string, node_type string"), spark.createDataFrame([("a", "b", "substrate"), ("b", "c", "product"), ("n", "b", "product")], "src string, dst string, rel string"))
    e = spark.createDataFrame([("s", "a", 1.0, 1.0), ("s", "n", 1.0, 1.0)], "sample_id string, node_id string, effect_size double, confidence double")
    anchor = spark.createDataFrame([("n",)], "node_id string")
    got = {r["node_id"]: (r["p_down"], r["p_normal"], r["p_up"]) for r in inference.belief_propagation(g, e, rounds=200, tol=1e-10, anchors=anchor).collect()}
    s, prior = np.array([-1, 0, 1]), np.array([1, 1.5, 1]) / 3.5
    like, sure, agree = np.exp(-0.5 * (1 - s) ** 2), np.array([0.025, 0.95, 0.025]), np.exp(np.outer(s, s))
    joint = np.einsum("i,j,k,l,ij,jk,jl->ijkl", prior * like, prior, prior, prior * sure, 1 / agree, agree, agree)
    joint /= joint.sum()
    for n, axis in (("a", (1, 2, 3)), ("b", (0, 2, 3)), ("c", (0, 1, 3)), ("n", (0, 1, 2))):
        assert got[n] == pytest.approx(joint.sum(axis), abs=1e-6)


def test_axes_against_numpy(spark):
    rng = np.random.default_rng(0)
    f = rng.normal(size=(12, 6))
    x = spark.createDataFrame([(i, j, float(f[i, j])) for i in range(12) for j in range(6)], "patient_id int, node int, value double")
    u, s, vt = np.linalg.svd(f - f.mean(0), full_matrices=False)
    got = {(r["patient_id"], r["pc"]): (r["score"], r["explained"]) for r in axes.pca(x, 3).collect()}
    for c in range(3):
        score = np.array([got[i, c + 1][0] for i in range(12)])
        assert abs(score @ (u[:, c] * s[c])) == pytest.approx(s[c] ** 2) and got[0, c + 1][1] == pytest.approx(s[c] ** 2 / (s**2).sum())
    loo = {(r["patient_id"], r["pc"]): r["cosine"] for r in models.loo_stability(x, 2).collect()}
    rest = np.delete(f, 3, 0)
    v2 = np.linalg.svd(rest - rest.mean(0), full_matrices=False)[2]
    assert loo[3, 1] == pytest.approx(abs(v2[0] @ vt[0]), abs=1e-9)


def test_models(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 5))
    y = np.repeat([1.0, -1.0], 15)
    x[:15, 2] += 3
    w, vip = models.pls(x, y, 2)
    assert np.argmax(np.abs(w[:, 0])) == 2 and np.argmax(vip) == 2 and (vip**2).mean() == pytest.approx(1)
    src, dst = np.array([0, 0, 1, 3, 3, 4, 2]), np.array([1, 2, 2, 4, 5, 5, 3])
    lab = models.louvain(6, src, dst, np.ones(7))
    assert lab[0] == lab[1] == lab[2] != lab[3] == lab[4] == lab[5]
    c = spark.createDataFrame([(f"n{i:02d}", float(i)) for i in range(40)], "node_id string, value double")
    q = c.where("node_id IN ('n00', 'n39')")
    null = models.matched_null(c, q, draws=30, bins=4).collect()
    assert len(null) == 60 and all(r["pick"] not in ("n00", "n39") for r in null)
    assert all(abs(int(r["pick"][1:]) - int(r["node_id"][1:])) <= 11 for r in null)
    r = models.recommend(models.Cohort(150, 120, ("metab",), {"metab": 800}, paired=True))
    assert (r["evidence_model"], r["propagation"], r["expected_auc"]) == ("diablo", "signed_laplacian", (0.85, 0.97))
    assert models.recommend(models.Cohort(4, 3))["evidence_model"] == "welch_t"


def test_names(spark):
    d = spark.createDataFrame([("L-Cit",), ("kynurenate",), ("C02703_Serine O-sulfate",), ("butyrate; x/y",), ("",), (None,)], "n string")
    got = {r["n"]: r for r in d.select("n", names.without_stereo("n").alias("bare"), names.salt_variants("n").alias("salt"), names.candidates("n").alias("c"), names.split_variants("n").alias("v")).collect()}
    assert got["L-Cit"]["bare"] == "Cit" and got["kynurenate"]["salt"] == ["kynurenic acid", "kynurenoic acid"]
    assert got["C02703_Serine O-sulfate"]["c"] == ["C02703_Serine O-sulfate", "Serine O-sulfate", "C02703"]
    assert got["butyrate; x/y"]["v"] == ["butyrate; x/y", "butyrate", "x", "y"] and got[""]["v"] == []
    assert spark.range(1).select(names.hmdb(F.lit("HMDB1"))).first()[0] == "HMDB0000001"


def test_lipids(spark):
    want = {
        "PC 36:2": ("PC", "GP", 36, 2, "acyl", 0), "DG O-32:1": ("DG", "GL", 32, 1, "ether", 0), "PC P-34:0 or PC O-34:1": ("PC", "GP", 34, 1, "ether", 0), "PE P-34:0": ("PE", "GP", 34, 0, "plasmalogen", 0),
        "Cer 18:1;O2/24:0": ("Cer", "SP", 42, 1, "acyl", 2), "CAR 10:1;OH": ("CAR", "FA", 10, 1, "acyl", 1), "HexCer 24:2;O2;O": ("HexCer", "SP", 24, 2, "acyl", 3), "1-DeoxyCer 18:0;O/16:0": ("1-DeoxyCer", "SP", 34, 0, "acyl", 1),
        "Coenzyme Q10": ("Coenzyme Q", "PR", None, None, "acyl", None), "Sphingosine-1-phosphate": ("SPBP", "SP", None, None, "acyl", None), "Oleic acid": ("FFA", "FA", None, None, "acyl", None), "TG 48:0*": ("TG", "GL", 48, 0, "acyl", 0),
    }
    d = spark.createDataFrame([(n,) for n in [*want, "nothing known"]], "n string").select("n", lipids.parse("n").alias("l")).collect()
    for r in d:
        x = r["l"]
        if r["n"] in want:
            assert (x["sub_class"], x["category"], x["carbons"], x["double_bonds"], x["linkage"], x["hydroxyls"]) == want[r["n"]], r["n"]
        else:
            assert not x["resolved"] and x["sub_class"] == "UNKNOWN"


def test_resolution(spark, chain):
    n = chain.nodes.withColumns({"chebi_id": F.when(F.col("node_id") == "A", "CHEBI:7"), "name": F.when(F.col("node_id") == "B", "Kynurenic acid [cytosol]").otherwise(F.col("name"))})
    idx = resolve.metabolite_index(Graph(n, chain.edges))
    f = spark.createDataFrame([("chebi:7",), ("KYNURENATE",), ("zzz; CHEBI_7",), ("C",), ("who",), (None,)], "feature_id string")
    got = {r["feature_id"]: (r["node_id"], r["confidence"]) for r in resolve.map_metabolites(f, idx).collect()}
    assert got == {"chebi:7": ("A", 1.0), "KYNURENATE": ("B", 1.0), "zzz; CHEBI_7": ("A", 1.0), "C": ("C", 1.0), "who": (None, None)}
    fz = spark.createDataFrame([("kynurenic acyd",), ("kyn",)], "feature_id string")
    hit = resolve.fuzzy(fz, idx).collect()
    assert [(r["feature_id"], r["node_id"]) for r in hit] == [("kynurenic acyd", "B")]
    assert hit[0]["confidence"] == pytest.approx(min(0.95, difflib.SequenceMatcher(None, "kynurenic acyd", "kynurenic acid").ratio()))
    w = resolve.with_fallback(spark.createDataFrame([("Kynurenic acid (x)",)], "feature_id string"), lambda d: resolve.map_metabolites(d, idx)).first()
    assert (w["node_id"], w["confidence"]) == ("B", 0.9)


def test_twins(spark):
    cols = "node_id string, node_type string, name string, chebi_id string, hmdb_id string"
    n = spark.createDataFrame([("m1", "metabolite", "Glucose", None, None), ("m2", "metabolite", "D-glucose", None, "HMDB1"), ("r", "reaction", None, None, None), ("d", "disease", None, None, None)], cols)
    e = spark.createDataFrame([("m1", "r", "substrate"), ("d", "m2", "marks")], "src string, dst string, rel string")
    g = resolve.collapse_twins(Graph(n, e), ["hmdb_id"])
    assert rows(g.nodes.where("node_type = 'metabolite'"), "node_id", "hmdb_id") == [("m1", "HMDB1")] and rows(g.edges, "src", "dst") == [("d", "m1"), ("m1", "r")]


def test_currency(spark, chain):
    n = chain.nodes.withColumn("name", F.when(F.col("node_id") == "A", "H2O [cytosol]").when(F.col("node_id") == "C", "an unknown acceptor").otherwise(F.col("name")))
    g = Graph(n, chain.edges)
    assert rows(currency.currency(g), "node_id", "currency_match") == [("A", "name"), ("ATP", "name"), ("C", "pattern")]
    skips = currency.conditional_skips(g, [("two", ["b", "atp"])], {"p": ["b"]})
    assert rows(skips, "metabolite", "reaction") == [("ATP", "R2")]
    assert currency.without_skips(chain.edges, skips).count() == 6


def test_basins(spark):
    load = spark.createDataFrame([(1, n, v) for n, v in (("a", 0.9), ("b", 0.8), ("c", 0.7), ("d", 0.1), ("x", -0.5), ("y", -0.4))], "pc int, node_id string, loading double")
    e = spark.createDataFrame([("a", "b"), ("b", "d"), ("x", "c")], "src string, dst string")
    assert rows(ranking.signed_basins(load, e, 3), "sign", "node_id") == [(-1, "x"), (1, "a"), (1, "b")]
    assert rows(ranking.signed_basins(load, e, 2, first=False), "sign", "node_id") == [(-1, "x"), (1, "a"), (1, "b")]


def test_files(spark, tmp_path, chain):
    p = tmp_path / "g.json"
    p.write_text(json.dumps({"nodes": [{"id": "a", "node_type": "metabolite"}, {"id": "b", "node_type": "reaction"}], "edges": [{"source": "a", "target": "b", "role": "Product"}, {"source": "a", "target": "b", "role": "SUBSTRATE"}]}))
    g = graphs.read_node_link(spark, str(p))
    assert rows(g.edges, "src", "dst", "rel") == [("a", "b", "substrate")]
    graphs.write_node_link(chain, str(tmp_path / "o.json"))
    back = json.loads((tmp_path / "o.json").read_text())
    assert len(back["nodes"]) == 7 and len(back["links"]) == 7
    graphs.write_graphml(chain, str(tmp_path / "o.graphml"))
    x = graphs.read_graphml(spark, str(tmp_path / "o.graphml"))
    assert rows(x.edges, "src", "dst", "rel") == rows(chain.edges, "src", "dst", "rel")
    assert {r["node_id"]: r["pathways"] for r in x.nodes.collect()}["R1"] == ["p", "q"]
    m = graphs.save_bundle(chain, str(tmp_path / "b"))
    assert m["node_counts"] == {"metabolite": 4, "reaction": 2, "gene": 1} and graphs.load_bundle(spark, str(tmp_path / "b")).edges.count() == 7


def test_readers(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    obo = graphs.read_obo(spark, put("o.obo", 'format-version: 1.2\n\n[Term]\nid: HP:1\nname: root\n\n[Term]\nid: HP:2\nname: kid\ndef: "A \\"b\\"" [x]\nxref: OMIM:5 {a="b"}\nsynonym: "Kid" EXACT []\nis_a: HP:1 ! root\n\n[Typedef]\nid: t\n'))
    assert rows(obo, "term_id", "name") == [("HP:1", "root"), ("HP:2", "kid")] and rows(graphs.descendants(obo, ["HP:1"]), "term_id") == [("HP:1",), ("HP:2",)]
    assert rows(graphs.xref_buckets(obo), "term_id", "prefix", "ids") == [("HP:2", "OMIM", ["5"])]
    dis = graphs.read_disorders(spark, put("d.xml", '<J><Disorder id="1"><OrphaCode>58</OrphaCode><Name lang="en">Foo</Name><ExternalReferenceList><ExternalReference><Source>OMIM</Source><Reference>203450</Reference></ExternalReference></ExternalReferenceList></Disorder></J>')).first()
    assert (dis["orpha_id"], dis["omim"], dis["genes"]) == ("ORPHA:58", ["203450"], [])
    mnx = tables.metanetx(spark, put("x.tsv", "# c\n#ID\tname\nM1\tfoo\nM2\t\n"), ["ID", "name"])
    assert rows(mnx, "ID", "name") == [("M1", "foo"), ("M2", None)]
    g = tables.gct(spark, put("e.gct", "#1.2\n2\t2\nName\tDescription\tLiver\tWhole Blood (x)\nENSG1.5\tA\t1.5\t0\nENSG2.1\tB\tbad\t2\n"))
    assert rows(g, "ensembl_id", "tissue", "tpm") == [("ENSG1", "liver", 1.5), ("ENSG2", "whole_blood_x", 2.0)]
    meta, data = tables.series_matrix(spark, put("s.txt", '!Sample_title\t"a"\t"b"\n!series_matrix_table_begin\n"ID_REF"\t"S1"\t"S2"\n"p1"\t1.5\tnull\n!series_matrix_table_end\n'))
    assert rows(meta, "sample", "value") == [("S1", "a"), ("S2", "b")] and rows(data, "probe", "sample", "value") == [("p1", "S1", 1.5)]
    csv = tables.read_delimited(spark, put("e.csv", 'Gene,LogFC,PVAL\nA,1.5,0.01\nB,x,0.2\n,2,0.1\nC,-1,0.9\n'))
    assert rows(tables.evidence(csv, p_most=0.5), "feature_id", "effect_size") == [("A", 1.5)]
    with pytest.raises(ValueError):
        tables.renamed(csv.drop("Gene"))
    cv = spark.createDataFrame([("GRCh38", "Pathogenic", "reviewed by expert panel", "G", "5", "9", "SNV"), ("GRCh38", "Benign", "reviewed by expert panel", "G", "6", "8", "SNV"), ("GRCh38", "Likely pathogenic", "no assertion", "G", "-1", "7", "SNV"), ("GRCh38", "Pathogenic", "criteria provided, single submitter", "H", "-1", "6", "Del")], "Assembly string, ClinicalSignificance string, ReviewStatus string, GeneSymbol string, `RS# (dbSNP)` string, VariationID string, Type string")
    assert rows(tables.clinvar(cv), "variant_id", "stars") == [("ClinVar:6", 1), ("rs:5", 3)]
    rx = graphs.reactome_reactions(spark, put("r.json", '{"stId":"R-1","displayName":"x","pathways":["b","a"],"input":[{"schemaClass":"SimpleEntity","stId":"s1","displayName":"ATP","identifier":"30616","compartment":"cytosol"},{"schemaClass":"Complex","stId":"c"}],"output":[{"schemaClass":"OtherEntity","stId":"s2","displayName":"y"}]}\n'))
    assert rows(rx.edges, "src", "dst") == [("CHEBI:30616@cytosol", "reactome:R-1"), ("reactome:R-1", "reactome:s2")]


def test_annotation(spark):
    n = spark.createDataFrame([("m", "k1", ["b"])], "node_id string, inchikey string, hazards array<string>")
    t = spark.createDataFrame([("k1", "50-00-0", "D1", ["c", "a"])], "inchikey string, cas_id string, dtxsid string, flags array<string>")
    got = annotate.add_hazards(n, t).first()
    assert (got["cas_id"], got["hazards"]) == ("50-00-0", ["a", "b", "c"])
    a = spark.createDataFrame([("p", 1.0), ("q", 0.0), ("r", 1.0)], "pathway_id string, value double")
    b = spark.createDataFrame([("p", 2.0), ("q", 2.0), ("r", 0.0), ("s", 0.0)], "pathway_id string, value double")
    assert rows(annotate.concordance(a, b), "pathway_id", "label") == [("p", "active"), ("q", "silent"), ("r", "exogenous"), ("s", "absent")]
    auto, man = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string"), spark.createDataFrame([("b", "9"), ("c", "3")], "k string, v string")
    assert rows(annotate.overridden(auto, man, "k", "v", spark.createDataFrame([("a",)], "k string")), "k", "v") == [("b", "9"), ("c", "3")]


def test_build_records_failures(spark, chain, tmp_path):
    b = Build(chain).add_pathways().add("broken", lambda g: g.filter_by_species("x").missing).add_currency(lambda g: currency.currency(g))
    g = b.run()
    assert [s["ok"] for s in b.log] == [True, False, True] and g.of_type("pathway").count() == 2
    b.save(g, str(tmp_path / "out"))
    assert verify(spark, str(tmp_path / "out"), ["pathways", "broken"]) == {"counts_match": True, "missing_steps": ["broken"]}


def test_stream(spark, tmp_path):
    from strandline import streaming

    spark.createDataFrame([("met:1", 1.0, 1.0), ("gene:2", 2.0, 0.5)], "node_id string, effect_size double, confidence double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("node_id string, effect_size double, confidence double").parquet(str(tmp_path / "in"))
    streaming.ingest(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "node_id", "kind") == [("gene:2", "gene"), ("met:1", "met")]


def test_more_statistics(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(20, 16))
    d = spark.createDataFrame([(f, float(v[f, s] + (f == 0 and s < 8) * 3), s < 8) for f in range(20) for s in range(16)], "feature_id int, value double, is_case boolean")
    t = {r["feature_id"]: r for r in stats.moderated_t(d).collect()}
    assert t[0]["p_value"] < 1e-3 and min(t[f]["df"] for f in t) > 14 and all(0 <= r["p_value"] <= 1 for r in t.values())
    e = spark.createDataFrame([("a", 1.0, -0.5), ("b", None, 0.5)], "node_id string, effect_size double, confidence double")
    assert [r["confidence"] for r in scoring.evidence_table(e).orderBy("node_id").collect()] == [0.0, 0.5]


@pytest.fixture(scope="module")
def crowd(spark):
    """R makes seven metabolites and a currency one, has seven genes, a modifier, and a substrate that R3 takes too."""
    kind = lambda t, *ids: [(i, t, i.lower(), False, i == "CUR", None, ["p"] if t == "reaction" else None) for i in ids]
    mets, genes = [f"M{i}" for i in range(7)], [f"G{i}" for i in range(7)]
    nodes = kind("metabolite", *mets, "S", "X", "CUR", "LONE") + kind("reaction", "R", "R3", "R4") + kind("gene", *genes) + kind("disease", "D1", "D2")
    edges = [("R", m, "product", None) for m in [*mets, "CUR"]] + [(g, "R", "catalysis", None) for g in genes]
    edges += [("S", "R", "substrate", None), ("S", "R3", "substrate", None), ("CUR", "R", "substrate", None), ("X", "R", "modifier", None), ("G0", "R4", "gene_reaction", None)]
    edges += [("D1", "G0", "disease_gene", 0.5), ("D2", "G0", "disease_gene", None)]
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "src string, dst string, rel string, score double"))


def test_chains_by_hand(spark, crowd):
    s = spark.createDataFrame([("R", -2.0)], "reaction_id string, score double")
    e = spark.createDataFrame([("M0", -3.0, 0.5), ("M0", 1.0, 1.0), ("S", 2.0, 0.5), ("G0", 9.0, 1.0)], "node_id string, effect_size double, confidence double")
    got = {tuple(r["path"]): r["score"] for r in ranking.rank_chains(crowd, s, e).collect()}
    # no currency product, six products at most, all seven genes, three products from each disease; no chain from a substrate
    assert len(got) == 7 * 6 + 2 * 3 and not any("CUR" in p or "M6" in p for p in got) and ("D2", "G0", "R", "M2") in got and ("D2", "G0", "R", "M3") not in got
    w = {"M": 1.0, "G0": 4**-0.5, "G1": 1.0, "D": 1.0}
    assert got["G1", "R", "M0"] == pytest.approx(2 * 0.8 * w["G1"] * 0.8 + 0.05 * 2.5)
    assert got["D1", "G0", "R", "M1"] == pytest.approx(2 * 0.8**3 * 0.5 * w["G0"]) and got["D2", "G0", "R", "M1"] == pytest.approx(2 * 0.8**3 * 0.4 * w["G0"])
    more = {tuple(r["path"]): r["score"] for r in ranking.rank_chains(crowd, s, e, spread=True).collect()}
    assert set(more) - set(got) == {("S", "R", f"M{i}") for i in range(6)}
    assert more["S", "R", "M1"] == pytest.approx(2 * 0.64 * 2**-0.5 * 1.1)


def test_perturbability_by_hand(spark, crowd):
    d = spark.createDataFrame([("G0", 0.55), ("G1", 0.3), ("G9", 1.0)], "gene_id string, druggability double")
    got = {r["reaction_id"]: r for r in scoring.perturbability(crowd, d).collect()}
    # S has one other consumer, currency doesn't count; X modifies; R3 has no enzyme
    assert set(got) == {"R", "R4"} and got["R"]["perturbability"] == pytest.approx(0.55 - 0.15 + 0.05) and got["R4"]["perturbability"] == pytest.approx(0.55)
    assert (got["R"]["n_enzymes"], got["R"]["alternative_routes"], got["R"]["cofactor_dependent"]) == (2, 1.0, True)


def test_branch_points_by_hand(crowd):
    got = {r["node_id"]: r for r in scoring.branch_points(crowd).collect()}
    assert (got["LONE"]["degree"], got["LONE"]["n_pathways"]) == (0, 0) and (got["S"]["n_reactions"], got["S"]["n_pathways"]) == (2, 1) and got["X"]["degree"] == 1
    assert got["CUR"]["degree"] == 1 and got["S"]["branch_score"] == pytest.approx(np.log(2) * got["S"]["pagerank"]) and got["S"]["pagerank"] > got["M0"]["pagerank"]


def test_over_representation_outside_background(spark):
    pairs = lambda p, ids: [(p, i) for i in ids]
    m = spark.createDataFrame(pairs("a", "1234xy") + pairs("big", "123456xyz"), "pathway_id string, node_id string")
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "node_id string")
    got = enrichment.over_representation(m, ids("1x9"), ids("1234567890"), 3, 8).collect()
    # x is a hit outside the background and counts; nine members are over the limit though six are inside
    (r,) = got
    assert (r["pathway_id"], r["n_pathway"], r["n_hits"]) == ("a", 4, 2) and r["expected"] == pytest.approx(1.2) and r["p_value"] == pytest.approx(1 / 3)


def test_preranked_of_falling_sets(spark):
    m = spark.createDataFrame([("low", "n3"), ("low", "n5"), ("zero", "z1"), ("zero", "z2")], "pathway_id string, node_id string")
    r = spark.createDataFrame([("n1", 3.0), ("n2", 1.0), ("z1", 0.0), ("z2", 0.0), ("n3", -0.5), ("n4", -0.7), ("n5", -1.5)], "node_id string, score double")
    got = {x["pathway_id"]: x for x in enrichment.preranked(m, r, 2).collect()}
    # before n3 four of five others have fallen; the leading edge has members up to there: none
    assert got["low"]["es"] == pytest.approx(-0.8) and got["low"]["leading_edge"] == ""
    # a set of zeros never rises: it is farthest from zero at the end
    assert got["zero"]["es"] == pytest.approx(-1.0) and got["zero"]["leading_edge"] == "z1,z2"
    assert got["low"]["nes"] == pytest.approx(-0.8 / 0.9)


def test_readiness_by_hand(crowd):
    from strandline.operators import qc

    got = {r["metric"]: r["value"] for r in qc.readiness(crowd, True).collect()}
    # all metabolites but CUR lack a side; R3 and R4 lack products, and R4 substrates
    assert got["dead_ends"] == 10 and got["orphan_reactions"] == 2 and got["n_currency"] == 1 and got["disease_gene_edges"] == 2
    assert got["degree_max"] == 2 and got["degree_mean"] == pytest.approx(11 / 11) and got["components"] == 3 and got["isolated_nodes"] == 2
    assert not qc.is_ready(qc.readiness(crowd))


def test_consistency_counts_zero_as_positive(spark, chain):
    s = spark.createDataFrame([("R1", 0.0, 1.0, 1), ("R2", 2.0, 1.0, 1)], "reaction_id string, score double, direction double, evidence_count long")
    got = {r["pathway_id"]: r["sign_consistency"] for r in scoring.summarise_pathways(chain, s).collect()}
    assert got == {"p": 1.0, "q": 1.0}


def test_moderated_t_against_formulas(spark):
    from strandline.functions import special as sp

    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 9)) * rng.gamma(1.0, 1.0, 12)[:, None]
    x[11] = 4.0
    data = [(f"f{i}", float(v), j < 4) for i, row in enumerate(x) for j, v in enumerate(row)]
    got = {r["feature_id"]: r for r in stats.moderated_t(spark.createDataFrame(data, "feature_id string, value double, is_case boolean")).collect()}
    s2 = (3 * x[:, :4].var(1, ddof=1) + 4 * x[:, 4:].var(1, ddof=1)) / 7
    ok = s2[:11]
    s0 = np.exp(np.log(ok).mean() - (sp.digamma(3.5) - np.log(3.5)))
    tri = lambda y: (sp.digamma(y + 1e-5) - sp.digamma(y - 1e-5)) / 2e-5
    extra = np.log(ok).var(ddof=1) - tri(3.5)
    assert extra > 0
    d0 = 2 * sp.inverse_trigamma(extra)
    t = (x[:, :4].mean(1) - x[:, 4:].mean(1)) / np.sqrt((7 * s2 + d0 * s0) / (7 + d0) * (1 / 4 + 1 / 5))
    assert len(got) == 12 and all(got[f"f{i}"]["t"] == pytest.approx(t[i], rel=1e-4, abs=1e-9) for i in range(12)) and got["f0"]["df"] == pytest.approx(7 + d0, rel=1e-4)


def test_modules_need_a_change(spark):
    nodes = [(f"r{i}", "reaction", None, False, False, None, None) for i in range(4)] + [("m", "metabolite", None, False, False, None, None)]
    g = Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame([(f"r{i}", "m", "product") for i in range(4)], "src string, dst string, rel string"))
    p = spark.createDataFrame([(f"r{i}", 0.5 + c, 0.5 - c) for i, c in enumerate((0.2, 0.2, 0.001, 0.001))], "reaction_id string, p_up double, p_down double")
    (r,) = ranking.perturbation_modules(g, p).collect()
    assert r["size"] == 4 and r["direction"] == "mixed" and r["members"] == "r0,r1,r2,r3"
