"""Chains of evidence, perturbation modules, signed basins, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, flag, top_per
from .iterate import components, cut, largest_component


def rank_chains(g: Graph, scores: DataFrame, evidence: DataFrame | None = None, decay: float = 0.8, least: float = 0.0, most: int = 1000, mets: int = 6, short: int = 3, spread: bool = False) -> DataFrame:
    """path, kind, score, rank: gene-reaction-metabolite, disease-gene-reaction-metabolite and (``spread``) metabolite-reaction-metabolite chains.

    |reaction score| is multiplied by ``decay`` for each hop and by 1 / root of the degree of
    each node but the reaction; 0.05 x the end's evidence (sum of |effect x confidence|) is
    added. Chains from a disease are multiplied by their edge's score (0.4 if it has none);
    chains from a substrate begin only where it has evidence, and 1 + a tenth of that
    multiplies them. Ends are products that aren't currency, ``mets`` of a reaction at most
    (``short`` for diseases), the first by id; genes and diseases aren't capped. The best
    ``most`` are given.
    """
    s = cut(scores.where(F.abs("score") >= least).select("reaction_id", F.abs("score").alias("base")))  # used four times
    told = (F.col("score") if "score" in g.edges.columns else F.lit(None)).cast("double").alias("conf")
    e = g.edges.select("src", "dst", "rel", told)
    kept = lambda kind: g.of_type(kind).where(~flag("is_currency")) if kind == "metabolite" else g.of_type(kind)
    hub = g.total_degree().select("node_id", (1 / F.sqrt(F.greatest("degree", F.lit(1)))).alias("w"))
    ev = None if evidence is None else evidence.groupBy("node_id").agg(F.sum(F.abs(F.col("effect_size") * F.col("confidence"))).alias("ev"))
    info = hub.withColumn("ev", F.lit(0.0)) if ev is None else hub.join(ev, "node_id", "left").withColumn("ev", F.coalesce("ev", F.lit(0.0)))
    info = cut(info.join(g.of_type("reaction").select("node_id"), "node_id", "left_anti"))

    def side(name: str, kind: str, rxn: str, node: str, *rel: str) -> DataFrame:
        """(reaction_id, name, its weight and evidence) along edges between scored reactions and nodes of a kind."""
        d = e.where(F.col("rel").isin(*rel)) if rel else e
        d = d.select(F.col(rxn).alias("reaction_id"), F.col(node).alias(name)).join(s.select("reaction_id"), "reaction_id", "left_semi")
        return d.join(kept(kind).select(F.col("node_id").alias(name)), name, "left_semi").distinct()

    known = lambda d, c: d.join(info.select(F.col("node_id").alias(c), F.col("w").alias(f"{c}_w"), F.col("ev").alias(f"{c}_ev")), c)
    right = known(top_per(side("met", "metabolite", "src", "dst", "product"), ["reaction_id"], [F.asc("met")], mets).withColumnRenamed("rank", "place"), "met")
    enzymes = known(side("gene", "gene", "dst", "src"), "gene")
    dis = e.select(F.col("src").alias("dis"), F.col("dst").alias("gene"), "conf").join(g.of_type("disease").select(F.col("node_id").alias("dis")), "dis", "left_semi")
    dis = known(dis.withColumn("conf", F.when(F.col("conf") != 0, F.col("conf")).otherwise(0.4)), "dis")

    def chain(d: DataFrame, kind: str, times: Column, nodes: list[str]) -> DataFrame:
        score = F.col("base") * F.pow(F.lit(decay), len(nodes) - 1) * times * F.col("met_w") + 0.05 * F.col("met_ev")
        return d.select(F.array(*nodes).alias("path"), F.lit(kind).alias("kind"), score.alias("score"))

    gr = s.join(enzymes, "reaction_id")
    p = chain(gr.join(right, "reaction_id"), "gene", F.col("gene_w"), ["gene", "reaction_id", "met"])
    few = right.where(F.col("place") <= short)
    p = p.unionByName(chain(gr.join(dis, "gene").join(few, "reaction_id"), "disease", F.col("conf") * F.col("gene_w") * F.col("dis_w"), ["dis", "gene", "reaction_id", "met"]))
    if spread:
        left = known(top_per(side("sub", "metabolite", "dst", "src", "substrate"), ["reaction_id"], [F.asc("sub")], mets).drop("rank"), "sub").where("sub_ev <> 0")
        p = p.unionByName(chain(s.join(left, "reaction_id").join(right, "reaction_id"), "metabolite", F.col("sub_w") * (1 + 0.1 * F.col("sub_ev")), ["sub", "reaction_id", "met"]))
    # sums in different orders differ in their last bits: ties are taken at nine digits
    best = p.orderBy(F.desc(F.round("score", 9)), "path").limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "path")))


def coadjacency(g: Graph, reactions: DataFrame, hub: int = 30) -> DataFrame:
    """(a, b, shared) with a < b: pairs of the given reactions that share metabolites or genes touching ``hub`` of them at most."""
    typed = g.of_type("metabolite", "gene").select(F.col("node_id").alias("other"))
    t = cut(g.both_ways().select("node_id", "other").join(reactions.select("node_id"), "node_id", "left_semi").join(typed, "other", "left_semi").distinct())
    few = t.groupBy("other").agg(F.count("*").alias("n")).where(F.col("n") <= hub).select("other")
    t = t.join(few, "other")
    return (
        t.select("other", F.col("node_id").alias("a")).join(t.select("other", F.col("node_id").alias("b")), "other").where("a < b")
        .groupBy("a", "b").agg(F.count("*").alias("shared"))
    )


def perturbation_modules(g: Graph, posterior: DataFrame, k: int = 200, least: int = 3, hub: int = 30, same: float = 0.7) -> DataFrame:
    """module, size, mean_change, direction, members: components of the k most changed reactions that share neighbours.

    posterior: (reaction_id, p_up, p_down); direction is up or down where over ``same`` of the members change by more than 0.01 that way.
    """
    d = posterior.select(F.col("reaction_id").alias("node_id"), (F.col("p_up") - F.col("p_down")).alias("change"))
    top = cut(d.orderBy(F.desc(F.abs("change")), "node_id").limit(k))
    comp = components(top.select("node_id"), coadjacency(g, top, hub).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    m = top.join(comp, "node_id").groupBy(F.col("component").alias("module")).agg(
        F.count("*").alias("size"), F.avg(F.abs("change")).alias("mean_change"), F.avg((F.col("change") > 0.01).cast("double")).alias("up"), F.avg((F.col("change") < -0.01).cast("double")).alias("down"),
        F.array_join(F.array_sort(F.collect_list("node_id")), ",").alias("members"),
    )
    direction = F.when(F.col("up") > same, "up").when(F.col("down") > same, "down").otherwise("mixed")
    return m.where(F.col("size") >= least).select("module", "size", "mean_change", direction.alias("direction"), "members")


def signed_basins(loadings: DataFrame, edges: DataFrame, k: int = 200, first: bool = True) -> DataFrame:
    """(pc, sign, node_id, loading, rank, mass): per axis and sign the largest component of the top-k nodes (``first``), or the top k of the largest component.

    loadings: (pc, node_id, loading). mass is the basin's share of the axis's squared loadings.
    """
    d = loadings.where("loading <> 0").withColumn("sign", F.signum("loading").cast("int"))
    order = [F.desc(F.abs("loading")), F.asc("node_id")]
    if first:
        d = top_per(d, ["pc", "sign"], order, k).drop("rank")
    keep = largest_component(d, edges, ["pc", "sign"])
    b = top_per(d.join(keep, ["pc", "sign", "node_id"]), ["pc", "sign"], order, k)
    total = loadings.groupBy("pc").agg(F.sum(F.col("loading") * F.col("loading")).alias("total"))
    mass = F.sum(F.col("loading") * F.col("loading")).over(Window.partitionBy("pc", "sign")) / F.col("total")
    return b.join(total, "pc").withColumn("mass", mass).drop("total")


def basin_overlaps(basins: DataFrame, least: int = 5, jaccard: float = 0.3) -> DataFrame:
    """(a, b, shared, jaccard) of basins (basin, cohort, node_id) of different cohorts: an equi-join on nodes."""
    size = basins.groupBy("basin").agg(F.count("*").alias("n"))
    d = basins.join(size, "basin")
    x = d.select("node_id", F.col("basin").alias("a"), F.col("cohort").alias("ca"), F.col("n").alias("na"))
    y = d.select("node_id", F.col("basin").alias("b"), F.col("cohort").alias("cb"), F.col("n").alias("nb"))
    p = x.join(y, "node_id").where("a < b AND ca <> cb").groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    j = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return p.withColumn("jaccard", j).where((F.col("shared") >= least) & (F.col("jaccard") >= jaccard)).select("a", "b", "shared", "jaccard")


def top_recall(ranked: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """(cohort, k, recall, expected, fold) of truth nodes among a cohort's first k by score (ties: id)."""
    w = Window.partitionBy("cohort")
    d = ranked.withColumns({"r": F.row_number().over(w.orderBy(F.desc("score"), "node_id")), "n": F.count("*").over(w)})
    d = d.join(truth.select("cohort", "node_id", F.lit(1).alias("true")), ["cohort", "node_id"], "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    a = d.groupBy("cohort", "k").agg(F.sum("true").alias("all"), F.sum(F.when(F.col("r") <= F.col("k"), F.col("true"))).alias("got"), F.first("n").alias("n")).where("all > 0")
    recall = F.coalesce("got", F.lit(0)) / F.col("all")
    expected = F.least(F.lit(1.0), F.col("k") / F.col("n"))
    return a.select("cohort", "k", recall.alias("recall"), expected.alias("expected"), (recall / expected).alias("fold"))


def bootstrap(scores_of, evidence: DataFrame, n_boot: int = 50, seed: int = 0) -> DataFrame:
    """(boot, ...) rows of ``scores_of(evidence)`` for resamples with replacement.

    Every record is drawn by a Poisson(1) count from a hash of seed, resample and
    record, the distributed form of resampling: no positions, no gathering. Equal
    records are told apart by their place among their equals.
    """
    names = evidence.columns
    equals = evidence.groupBy(*names).agg(F.count("*").alias("__equal")).withColumn("__equal", F.explode(F.sequence(F.lit(1), F.col("__equal"))))
    d = equals.withColumn("boot", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    u = F.pmod(F.xxhash64(F.lit(seed), "boot", "__equal", *names), F.lit(1 << 30)) / float(1 << 30)
    cuts, p, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += p
        cuts.append(total)
        p /= k + 1
    times = sum((F.when(u > c, 1).otherwise(0) for c in cuts), F.lit(0))
    return scores_of(d.withColumn("times", times).where("times > 0").drop("__equal"))
