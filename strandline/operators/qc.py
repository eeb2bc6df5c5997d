"""Readiness figures of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, flag
from .iterate import components, cut


#: Attributes whose share of nodes is reported where the node table has them.
COMPLETENESS = {"reaction": ("ec_numbers", "gene_symbols", "pathways"), "metabolite": ("formula", "inchikey", "chebi_id", "hmdb_id")}


def readiness(g: Graph, with_components: bool = False) -> DataFrame:
    """(metric, value): counts by type, currency, dead ends, orphan reactions, degrees of metabolites, completeness; components on demand.

    A dead end is a metabolite other than currency that no reaction makes or none takes; an
    orphan is a reaction without metabolites on one side. A metabolite's degree is its
    number of reactions; the 95th percentile is the sorted degrees' element floor(0.95 n),
    found through the histogram of degrees. Components are those of metabolites and reactions.
    """
    kinds = g.nodes.agg(*(F.count_if(F.col("node_type") == t).cast("double").alias(f"n_{t}s") for t in ("metabolite", "reaction", "disease", "gene")))
    kind = g.nodes.select("node_id", "node_type", flag("is_currency").alias("cur"))
    side = lambda c: kind.select(F.col("node_id").alias(c), F.col("node_type").alias(f"{c}_type"), ((F.col("node_type") == "metabolite") & F.col("cur")).alias(f"{c}_cur"))
    e = cut(g.edges.select("src", "dst").join(side("src"), "src", "left").join(side("dst"), "dst", "left"))
    from_ = lambda t: F.col("src_type") == t
    edges = e.agg(
        F.count("*").cast("double").alias("n_edges"), F.avg((F.coalesce("src_cur", F.lit(False)) | F.coalesce("dst_cur", F.lit(False))).cast("double")).alias("currency_edge_fraction"),
        *(F.count_if(from_("disease") & (F.col("dst_type") == t)).cast("double").alias(f"disease_{t}_edges") for t in ("metabolite", "reaction", "gene")),
    )
    to_rxn = e.where(from_("metabolite") & (F.col("dst_type") == "reaction")).select(F.col("src").alias("met"), F.col("dst").alias("rxn"), F.lit("in").alias("side"))
    to_met = e.where(from_("reaction") & (F.col("dst_type") == "metabolite")).select(F.col("dst").alias("met"), F.col("src").alias("rxn"), F.lit("out").alias("side"))
    pairs = to_rxn.unionByName(to_met)
    mets = g.of_type("metabolite").select(F.col("node_id").alias("met"), flag("is_currency").alias("cur"))
    per = mets.join(pairs.groupBy("met").agg(F.count_distinct("side").alias("sides"), F.count_distinct("rxn").alias("degree")), "met", "left").fillna(0, ["sides", "degree"])
    per = cut(per)
    ends = per.agg(F.count_if(F.col("cur")).cast("double").alias("n_currency"), F.count_if(~F.col("cur") & (F.col("sides") < 2)).cast("double").alias("dead_ends"), F.avg("degree").alias("degree_mean"), F.max("degree").cast("double").alias("degree_max"))
    full = pairs.groupBy("rxn").agg(F.count_distinct("side").alias("sides")).where("sides = 2").agg(F.count("*").alias("full"))
    h = per.groupBy("degree").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.orderBy("degree").rowsBetween(Window.unboundedPreceding, 0))  # one row a degree
    h = h.withColumn("upto", upto).crossJoin(per.agg(F.count("*").alias("n")))
    p95 = h.where(F.col("upto") > F.floor(F.lit(0.95) * F.col("n"))).agg(F.min("degree").cast("double").alias("degree_p95"))
    filled = lambda c, t: (F.size(c) > 0) if t.startswith("array") else (F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    types = dict(g.nodes.dtypes)
    shares = [
        F.avg(F.when(F.col("node_type") == t, F.coalesce(filled(c, types[c]), F.lit(False)).cast("double"))).alias(f"{t}s_with_{c}")
        for t, columns in COMPLETENESS.items() for c in columns if c in types
    ]
    if "compartment" in types:
        shares.append(F.count_distinct(F.when((F.col("node_type") == "metabolite") & (F.col("compartment") != ""), F.col("compartment"))).cast("double").alias("n_compartments"))
    one = kinds.crossJoin(edges).crossJoin(ends).crossJoin(full).crossJoin(p95)  # one row each
    if shares:
        one = one.crossJoin(g.nodes.agg(*shares))
    one = one.withColumn("orphan_reactions", F.col("n_reactions") - F.col("full")).drop("full")
    if with_components:
        ids = g.of_type("metabolite", "reaction")
        c = components(ids, pairs.select(F.col("met").alias("src"), F.col("rxn").alias("dst"))).groupBy("component").agg(F.count("*").alias("size"))
        c = c.agg(F.count("*").cast("double").alias("components"), (F.max("size") / F.sum("size")).alias("largest_component_fraction"), F.count_if(F.col("size") == 1).cast("double").alias("isolated_nodes"))
        one = one.crossJoin(c)
    return one.unpivot([], one.columns, "metric", "value").where("value IS NOT NULL")


#: What a graph must have to be ready for flux models (over, or for components under).
READY = {"n_metabolites": 100, "n_reactions": 50, "reactions_with_ec_numbers": 0.3, "metabolites_with_formula": 0.5, "components": 10}


def is_ready(figures: DataFrame) -> bool:
    """Whether the figures of ``readiness`` (with components) pass ``READY``; a missing one doesn't."""
    v = {r["metric"]: r["value"] for r in figures.where(F.col("metric").isin(*READY)).collect()}
    return all(c in v and (v[c] < x if c == "components" else v[c] > x) for c, x in READY.items())


def coverage(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """(node_type, column, share) of nodes that have an attribute."""
    has = [F.avg((F.col(c).isNotNull() & (F.col(c).cast("string") != "")).cast("double")).alias(c) for c in columns]
    return nodes.groupBy("node_type").agg(*has).unpivot("node_type", columns, "column", "share")
