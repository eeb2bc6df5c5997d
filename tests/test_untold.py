"""Hand-worked cases of functions that no query stands on."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.graph import Graph
from strandline.operators import axes, inference, resolve
from strandline.sources import annotate, tables


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_feeds(spark):
    mk = spark.createDataFrame
    ctd = mk([("50-00-0", "tp53", "Homo sapiens", "increases", "1|2|"), ("50-00-0", "TP53", "Mus musculus", "x", "1"), ("1-1-1", "TP53", "Homo sapiens", "y", None)], "CasRN string, GeneSymbol string, Organism string, InteractionActions string, PubMedIDs string")
    known = mk([("met:a", "50-00-0"), ("met:b", None)], "node_id string, cas_id string")
    genes = mk([("gene:1", "TP53")], "node_id string, symbol string")
    assert rows(tables.ctd_genes(ctd, known, genes), "src", "dst", "action", "reference_count") == [("met:a", "gene:1", "increases", 2)]
    lig = [("L1", "A|B", "agonist", "7.5", "true", "false", "Human"), ("L2", "C", "antagonist", None, "", "yes", "Human"), ("L3", "", "agonist", "1", "true", "true", "Human"), ("L4", "D", "agonist", "2", "true", "true", "Rat")]
    lig = mk(lig, "ligand string, target_gene_symbol string, action string, affinity string, endogenous string, approved string, target_species string")
    assert rows(tables.gtopdb(lig), "ligand", "gene_symbol", "affinity") == [("L1", "A", 7.5), ("L2", "C", None)]
    assert rows(tables.gtopdb(lig, endogenous=True), "ligand") == [("L1",)] and rows(tables.gtopdb(lig, approved=True), "ligand") == [("L2",)]
    pheno = mk([("HP:1", "BRCA1"), ("HP:1", "BRCA1"), (None, "X")], "hpo_id string, gene_symbol string")
    assert rows(tables.phenotype_genes(pheno), "hpo_id", "gene_id") == [("HP:1", "symbol:BRCA1")]
    tox = mk([("T1", None, "15377", "7-7-7", None, "LD50: 12.5 mg/kg"), ("T2", None, None, "7-7-7", None, "unknown")], "toxin string, hmdb_id string, chebi_id string, cas_number string, pubchem_id string, ld50_text string")
    index = mk([("cas", "7-7-7", "met:c"), ("chebi", "CHEBI:15377", "met:w")], "kind string, key string, node_id string")
    assert rows(tables.t3db(tox, index), "toxin", "node_id", "ld50", "ld50_unit") == [("T1", "met:w", 12.5, "mg/kg"), ("T2", "met:c", None, None)]


def test_resolution(spark):
    mk = spark.createDataFrame
    nodes = mk([("a", "x", "k"), ("b", " ", "k"), ("c", None, "m")], "node_id string, chebi string, key string")
    first, second = mk([("k", "one"), ("k", "other")], "key0 string, v string"), mk([("m", "two")], "key1 string, v string")
    got = resolve.fill_missing(nodes, "chebi", (first.withColumnRenamed("key0", "key"), "key", "v"), (second.withColumnRenamed("key1", "key"), "key", "v"))
    assert rows(got, "node_id", "chebi") == [("a", "x"), ("b", "one"), ("c", "two")]
    met = mk([("a", "metabolite", "AAAAAAAAAAAAAA-B"), ("b", "metabolite", "AAAAAAAAAAAAAA-C"), ("c", "metabolite", ""), ("g", "gene", "AAAAAAAAAAAAAA-B")], "node_id string, node_type string, inchikey string")
    assert rows(resolve.all_compartments(met.where("node_id = 'a'"), met), "node_id", "twin", "own") == [("a", "a", True), ("a", "b", False)]
    g = Graph(mk([("g1", "gene", "Abc"), ("g2", "gene", "ABC"), ("r", "reaction", None)], "node_id string, node_type string, symbol string"), mk([("g2", "s")], "src string, dst string"))
    said = mk([("r", "abc"), ("r", "ABC"), ("s", "abc"), ("r", "none")], "reaction_id string, symbol string")
    assert rows(resolve.link_genes(g, said), "src", "dst", "rel") == [("g2", "r", "catalysis")]


def test_annotation(spark):
    mk = spark.createDataFrame
    nodes = mk([("a", "HMDB00001", None), ("b", None, 7), ("c", None, None)], "node_id string, hmdb_id string, pubchem_cid int")
    by_h, by_p = mk([("HMDB0000001", "glc")], "hmdb_id string, abbreviation string"), mk([("7", "pyr")], "pubchem_cid string, abbreviation string")
    assert rows(annotate.vmh_ids(nodes, by_h, by_p), "node_id", "vmh_id") == [("a", "glc"), ("b", "pyr"), ("c", None)]
    named = mk([("a", "metabolite", "Glucose", ["dextrose"]), ("b", "metabolite", "Water", None), ("g", "gene", "glucose", None)], "node_id string, node_type string, name string, synonyms array<string>")
    hits = mk([("glucose", 3), ("dextrose", 4), ("iron", 9)], "chemical string, n_articles int")
    assert rows(annotate.literature_nodes(hits, named), "node_id", "n_articles", "chemicals") == [("a", 7, "dextrose;glucose")]
    t = mk([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "only")], "key string, at int, v string")
    assert rows(annotate.last_rows(t, "key", "at"), "key", "v") == [("j", "only"), ("k", "new")]
    book = mk([("glucose", None, None), ("Water ", "KEY", None)], "BIOCHEMICAL string, INCHIKEY string, PUBCHEM string")
    assert rows(annotate.unannotatable(Graph(named, named.limit(0)), book), "node_id", "unannotatable") == [("a", True), ("b", False)]


def test_axes_and_posteriors(spark):
    mk = spark.createDataFrame
    d = mk([("l", 0, 1.0), ("l", 0, 3.0), ("l", 1, 0.0), ("r", 0, 1.0), ("r", 1, 1.0), ("x", 0, 9.0)], "grp string, node int, delta double")
    r = axes.mean_delta_angle(d, "l", "r").first()
    assert r["cosine"] == pytest.approx(1 / math.sqrt(2)) and r["degrees"] == pytest.approx(45)
    v = mk([("a", 1.0), ("a", 5.0), ("b", 1.0), ("b", 2.0), ("c", 3.0), ("c", 3.0)], "feature_id string, value double")
    assert rows(axes.top_variance(v, 1), "feature_id", "value") == [("a", 1.0), ("a", 5.0)]
    load = mk([(1, i, float(x)) for i, x in enumerate((3, -4, 0, 1))], "pc int, node int, loading double")
    m = axes.narrow_mass(load, (1, 2)).first()
    assert (m["top_1"], m["top_2"]) == pytest.approx((16 / 26, 25 / 26))
    x = np.array([[1.0, 2.0], [3.0, 0.0], [2.0, 4.0]])
    c = x - x.mean(0)
    g = axes.gram(mk([(i, j, float(x[i, j])) for i in range(3) for j in range(2)], "patient_id int, node int, value double"))
    assert all(r["dot"] == pytest.approx(c[r["a"]] @ c[r["b"]]) for r in g.collect()) and g.count() == 6
    p = mk([("a", 0.7, 0.2, 0.1), ("b", 0.1, 0.6, 0.3)], "node_id string, p_up double, p_down double, p_normal double")
    assert inference.signed_scores(p).where("node_id = 'a'").select(F.round("signed", 6), F.round("perturbed", 6)).first()[:] == (0.5, 0.9)
    s = inference.log_posterior_score(p, mk([("a", 1), ("b", 0)], "node_id string, state int")).first()
    assert s["n"] == 2 and s["score"] == pytest.approx((math.log(0.7) + math.log(0.3)) / 2)
    best, top = inference.tune(lambda u, w: -((u - 2) ** 2) - (w - 1) ** 2, {"u": [0, 1, 2, 3], "w": [0, 1, 2, 3]}, {"u": 0, "w": 0})
    assert best == {"u": 2, "w": 1} and top == 0
