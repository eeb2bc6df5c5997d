"""Currency metabolites: lists, name patterns, hubs; and reactions where they count after all."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph

#: Names of common cofactors, lower-cased.
NAMES = (
    "atp", "adp", "amp", "gtp", "gdp", "nad+", "nadh", "nadp+", "nadph", "fad", "fadh2", "coa", "coenzyme a", "h2o", "water", "h+", "proton",
    "co2", "carbon dioxide", "o2", "oxygen", "pi", "phosphate", "ppi", "diphosphate", "ammonia", "nh3", "h2o2", "hydrogen peroxide",
)
#: Placeholders that stand for a class and not a compound.
ABSTRACT = (r"^(an?|the)\s+\w+(ed|ic)?\s+(acceptor|donor)\b", r"\b(generic|unspecified|unknown)\b", r"^r-\w+$")


def normal_name(c: Column | str) -> Column:
    """Lower-cased, without a trailing [compartment]."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), r"\s*\[[^\]]*\]\s*$", ""))


def abstract(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(c).rlike("|".join(f"({p})" for p in ABSTRACT)), F.lit(False))


def hubs(g: Graph, k: float) -> DataFrame:
    """node_id of metabolites of more reactions than the mean by k sample deviations, where there are over two."""
    d = g.reaction_degree()
    cut = d.agg((F.avg("degree") + k * F.stddev_samp("degree")).alias("cut"), F.count("*").alias("n"))
    return d.crossJoin(cut).where((F.col("n") > 2) & (F.col("degree") > F.col("cut"))).select("node_id")  # one row


def currency(g: Graph, keys: Iterable[str] = (), names: Iterable[str] = NAMES, k: float | None = None) -> DataFrame:
    """node_id, currency_match: by the first 14 of an InChIKey, by name, by pattern, by degree, in this order."""
    m = g.of_type("metabolite")
    key = F.substring("inchikey", 1, 14) if "inchikey" in m.columns else F.lit(None).cast("string")
    by_key, by_name, by_form = F.coalesce(key.isin(list(keys)), F.lit(False)), F.coalesce(normal_name("name").isin(list(names)), F.lit(False)), abstract("name")
    hub = hubs(g, k).withColumn("hub", F.lit(True)) if k is not None else None
    m = m.join(hub, "node_id", "left") if hub is not None else m.withColumn("hub", F.lit(False))
    match = F.when(by_key, "inchikey").when(by_name, "name").when(by_form, "pattern").when(F.coalesce("hub", F.lit(False)), "degree")
    return m.select("node_id", match.alias("currency_match")).where("currency_match IS NOT NULL")


def conditional_skips(g: Graph, rules: list[tuple[str, list[str]]], overrides: dict[str, list[str]]) -> DataFrame:
    """(metabolite, reaction) edges to skip: a reaction named like a rule's pattern skips its names, unless one of its pathways keeps them."""
    names = F.array().cast("array<string>")
    for pattern, skipped in rules:
        names = F.array_union(names, F.when(F.coalesce(F.lower("name").rlike(pattern), F.lit(False)), F.array(*map(F.lit, skipped))).otherwise(F.array().cast("array<string>")))
    for pathway, kept in overrides.items():
        names = F.when(F.coalesce(F.array_contains("pathways", pathway), F.lit(False)), F.array_except(names, F.array(*map(F.lit, kept)))).otherwise(names)
    rxn = g.of_type("reaction").select(F.col("node_id").alias("other"), F.explode(names).alias("skip"))
    met = g.of_type("metabolite").select("node_id", normal_name("name").alias("skip"))
    return g.both_ways().join(rxn, "other").join(met, ["node_id", "skip"]).select(F.col("node_id").alias("metabolite"), F.col("other").alias("reaction")).distinct()


def without_skips(edges: DataFrame, skips: DataFrame) -> DataFrame:
    """Edges less the skipped pairs, whichever way they point."""
    a = skips.select(F.col("metabolite").alias("src"), F.col("reaction").alias("dst"))
    return edges.join(a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), ["src", "dst"], "left_anti")
