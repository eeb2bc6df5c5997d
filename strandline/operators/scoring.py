"""Evidence on reactions, pathways, enzymes: signed, hub-weighted sums and what builds on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import Graph, flag, top_per
from .iterate import cut, laid, pagerank


def evidence_table(df: DataFrame) -> DataFrame:
    """Fills the direction from the effect's sign where it is missing and clamps confidence to 0..1 (1 where missing)."""
    d = F.when(F.col("effect_size") > 0, 1).when(F.col("effect_size") < 0, -1).otherwise(0)
    direction = F.coalesce(F.col("direction"), d) if "direction" in df.columns else d
    confidence = F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in df.columns else F.lit(1.0)
    return df.withColumns({"direction": direction, "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))})


def net_effect(evidence: DataFrame) -> DataFrame:
    """node_id, net_effect: the sum of effect x confidence over the number of records."""
    return evidence.groupBy("node_id").agg((F.sum(F.col("effect_size") * F.col("confidence")) / F.count("*")).alias("net_effect"), F.count("*").alias("n_records"))


def contributions(
    g: Graph, evidence: DataFrame, currency_weight: float = 0.0, hub_penalty: bool = True, gene_weight: float = 1.0, substrate_weight: float = 1.0, product_weight: float = 1.0
) -> DataFrame:
    """reaction_id, role, node_id, c, confidence: one row per reaction, neighbour and record.

    Depleted substrates, gathered products and risen enzymes speak for a reaction.
    Metabolites weigh 1/sqrt(their edges to reactions); currency ones their own weight
    (none by default, so they are filtered before the joins).
    """
    met = g.of_type("metabolite").select("node_id", flag("is_currency").alias("cur"))
    if currency_weight == 0:
        met = met.where(~F.col("cur"))
    if hub_penalty:
        met = met.join(g.reaction_degree(), "node_id").withColumn("w", 1 / F.sqrt("degree"))
    else:
        met = met.withColumn("w", F.lit(1.0))
    met = met.withColumn("w", F.when(F.col("cur"), F.col("w") * currency_weight).otherwise(F.col("w")))
    # weights and evidence meet on the metabolite once, for both sides
    seen = met.join(evidence.select("node_id", "effect_size", "confidence"), "node_id")
    value = F.col("effect_size") * F.col("confidence") * F.col("w")
    side = lambda rel, end, rxn, weight: (
        g.edges.where(F.col("rel") == rel)
        .select(F.col(end).alias("node_id"), F.col(rxn).alias("reaction_id"))
        .join(seen, "node_id")
        .select("reaction_id", F.lit(rel).alias("role"), "node_id", (value * weight).alias("c"), "confidence")
    )
    rows = []
    if substrate_weight:
        rows.append(side("substrate", "src", "dst", -substrate_weight))
    if product_weight:
        rows.append(side("product", "dst", "src", product_weight))
    gene = g.of_type("gene").select("node_id").join(evidence.select("node_id", "effect_size", "confidence"), "node_id")
    if g.at_reactions is not None:
        cat = g.at_reactions.where("rel <> 'product'").select("node_id", F.col("other").alias("reaction_id"))
    else:
        cat = g.edges.select(F.col("src").alias("node_id"), F.col("dst").alias("reaction_id")).join(g.of_type("reaction").select(F.col("node_id").alias("reaction_id")), "reaction_id", "left_semi")
    rows.append(cat.join(gene, "node_id").select("reaction_id", F.lit("gene").alias("role"), "node_id", (F.col("effect_size") * F.col("confidence") * gene_weight).alias("c"), "confidence"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def score_reactions(g: Graph, evidence: DataFrame, min_evidence: int = 1, detail: bool = False, **weights) -> DataFrame:
    """reaction_id, score, direction, reversible, evidence_count, confidence; with ``detail``, who supports and who contradicts.

    score = sum / sqrt(n), magnitudes for reversible reactions; direction is the mean
    of signs (zero counts as -1). Reactions of fewer records than ``min_evidence`` are left out.
    """
    rxn = g.of_type("reaction").select(F.col("node_id").alias("reaction_id"), flag("reversible").alias("reversible"))
    c = contributions(g, evidence, **weights).join(rxn, "reaction_id")
    size = F.when(F.col("reversible"), F.abs("c")).otherwise(F.col("c"))
    aggs = [
        (F.sum(size) / F.sqrt(F.count("*"))).alias("score"),
        F.avg(F.when(F.col("c") > 0, 1.0).otherwise(-1.0)).alias("direction"),
        F.first("reversible").alias("reversible"),
        F.count("*").alias("evidence_count"),
        F.avg("confidence").alias("confidence"),
    ]
    if detail:
        # collected and sorted once, with what each speaks for; then parted
        kind = F.when(F.col("role") == "gene", 1).when(F.col("reversible") | (F.col("c") >= 0), 0).when(F.col("c") < 0, 2)
        entry = F.struct((-F.abs("c")).alias("order"), "node_id", "role", "c", "confidence", kind.alias("kind"))
        aggs.append(F.sort_array(F.collect_list(F.when(kind.isNotNull(), entry))).alias("entries"))
    out = c.groupBy("reaction_id").agg(*aggs).where(F.col("evidence_count") >= min_evidence)
    if detail:
        part = lambda k: F.transform(F.filter("entries", lambda x: x["kind"] == k), lambda x: F.struct(*(x[f].alias(f) for f in ("order", "node_id", "role", "c", "confidence"))))
        out = out.withColumns({"supporting_metabolites": part(0), "supporting_genes": part(1), "contradictory_metabolites": part(2)}).drop("entries")
    return out


def summarise_pathways(g: Graph, scores: DataFrame, top: int = 5) -> DataFrame:
    """Per pathway: reactions, mean, median, sample deviation (0 of one), mean direction, share of the mean's sign (zero is positive), evidence, the top reactions."""
    member = g.of_type("reaction").select(F.col("node_id").alias("reaction_id"), F.explode("pathways").alias("pathway_id"))
    s = cut(scores.join(member, "reaction_id"))  # for the figures, and for the top reactions
    stats = s.groupBy("pathway_id").agg(
        F.count("*").alias("n_reactions"),
        F.avg("score").alias("mean_score"),
        F.median("score").alias("median_score"),
        F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("sd_score"),
        F.avg("direction").alias("mean_direction"),
        F.count_if(F.col("score") >= 0).alias("n_up"),
        F.count_if(F.col("score") < 0).alias("n_down"),
        F.sum("evidence_count").alias("total_evidence"),
    )
    same = F.when(F.col("mean_score") >= 0, F.col("n_up")).otherwise(F.col("n_down")) / F.col("n_reactions")
    best = top_per(s, ["pathway_id"], [F.desc(F.abs("score")), F.asc("reaction_id")], top)
    best = best.groupBy("pathway_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "reaction_id"))), lambda x: x["reaction_id"]), ",").alias("top_reactions"))
    return stats.withColumn("sign_consistency", same).join(best, "pathway_id").drop("n_up", "n_down")


#: Relations from a gene to a reaction that it makes possible.
ENZYME_RELATIONS = ("catalysis", "gene_reaction", "gene_associated")


def enzyme_gate(g: Graph, evidence: DataFrame, down: float = -0.5, floor: float = 0.3, combine: str = "min", also: tuple[str, ...] = ()) -> DataFrame:
    """reaction_id, gate: for each enzyme 1 at no change, falling linearly to ``floor`` at ``down``; combined by min, max or (geometric) mean.

    ``also``: further ways to combine in the same pass, a column each by their name.
    """
    e = F.col("effect_size")
    gate = F.when(e >= 0, 1.0).when(e <= down, floor).otherwise(floor + (1 - floor) * (1 - e / down))
    per = g.edges.where(F.col("rel").isin(*ENZYME_RELATIONS)).select(F.col("src").alias("node_id"), F.col("dst").alias("reaction_id")).join(evidence.select("node_id", gate.alias("gate")), "node_id")
    how = {"min": F.min("gate"), "max": F.max("gate"), "mean": F.exp(F.avg(F.log("gate")))}
    return per.groupBy("reaction_id").agg(how[combine].alias("gate"), *(how[x].alias(x) for x in also))


def apply_gate(scores: DataFrame, gate: DataFrame, default: float = 1.0) -> DataFrame:
    """Adds gate (``default`` where there is none) and gated_score."""
    s = scores.join(gate, "reaction_id", "left").withColumn("gate", F.coalesce("gate", F.lit(default)))
    return s.withColumn("gated_score", F.col("score") * F.col("gate"))


#: Score of a drug's highest phase.
PHASE_SCORES = {4: 1.0, 3: 0.75, 2: 0.55, 1: 0.3, 0: 0.1}
NO_PHASE = 0.05


def druggability(drug_edges: DataFrame) -> DataFrame:
    """gene_id, druggability, n_drugs, n_approved, best_drug from (gene_id, drug_id, max_phase)."""
    best = F.max(F.coalesce("max_phase", F.lit(-1)))
    table = F.create_map(*(F.lit(x) for kv in PHASE_SCORES.items() for x in kv))
    return drug_edges.groupBy("gene_id").agg(
        F.coalesce(F.try_element_at(table, best.cast("int")), F.lit(NO_PHASE)).alias("druggability"),
        F.count_distinct("drug_id").alias("n_drugs"),
        F.count_distinct(F.when(F.col("max_phase") == 4, F.col("drug_id"))).alias("n_approved"),
        F.max_by("drug_id", F.struct(F.coalesce("max_phase", F.lit(-1)), "drug_id")).alias("best_drug"),
    )


def perturbability(g: Graph, drug_scores: DataFrame, redundancy: float = 0.15, cofactor: float = 0.05) -> DataFrame:
    """reaction_id, n_enzymes, alternative_routes, cofactor_dependent, perturbability of reactions with an enzyme among ``drug_scores``.

    The best enzyme's druggability, less what other reactions make good (the mean number of
    others that consume its substrates, currency aside, x ``redundancy``, a half at most),
    and ``cofactor`` more where a metabolite modifies it; within 0..1.
    """
    rxn = g.of_type("reaction").select(F.col("node_id").alias("reaction_id"))
    mets = g.of_type("metabolite").select(F.col("node_id").alias("met"), flag("is_currency").alias("currency"))
    into = g.edges.select(F.col("src").alias("met"), F.col("dst").alias("reaction_id"), "rel").join(rxn, "reaction_id", "left_semi")
    enzyme = into.withColumnRenamed("met", "gene_id").join(g.of_type("gene").select(F.col("node_id").alias("gene_id")), "gene_id", "left_semi")
    best = enzyme.select("gene_id", "reaction_id").distinct().join(drug_scores.select("gene_id", "druggability"), "gene_id")
    best = best.groupBy("reaction_id").agg(F.max("druggability").alias("best"), F.count("*").alias("n_enzymes"))
    used = into.where("rel = 'substrate'").join(mets, "met")
    users = used.groupBy("met").agg((F.count("*") - 1).alias("others"))
    routes = used.where("NOT currency").join(users, "met").groupBy("reaction_id").agg(F.avg("others").alias("routes"))
    modified = into.where("rel = 'modifier'").join(mets, "met").select("reaction_id", F.lit(True).alias("modified")).distinct()
    d = best.join(routes, "reaction_id", "left").join(modified, "reaction_id", "left")
    mean, has = F.coalesce("routes", F.lit(0.0)), F.coalesce("modified", F.lit(False))
    p = F.col("best") - F.least(redundancy * mean, F.lit(0.5)) + F.when(has, cofactor).otherwise(0.0)
    return d.select("reaction_id", "n_enzymes", mean.alias("alternative_routes"), has.alias("cofactor_dependent"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("perturbability"))


def actionability(perturb: DataFrame, scores: DataFrame) -> DataFrame:
    """reaction_id, priority: perturbability x (1 + |reaction score|)."""
    s = perturb.join(scores.select("reaction_id", "score"), "reaction_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return s.withColumn("priority", F.col("perturbability") * (1 + F.abs("score")))


def met_reaction_pairs(g: Graph) -> DataFrame:
    """(node_id, other): metabolites and the reactions that they are substrates, products or modifiers of, each pair once."""
    e = g.edges.where(F.col("rel").isin("substrate", "product", "modifier"))
    both = e.select(F.col("src").alias("node_id"), F.col("dst").alias("other")).unionByName(e.select(F.col("dst").alias("node_id"), F.col("src").alias("other")))
    both = both.join(g.of_type("metabolite").select("node_id"), "node_id", "left_semi")
    return both.join(g.of_type("reaction").select(F.col("node_id").alias("other")), "other", "left_semi").select("node_id", "other").distinct()


def branch_points(g: Graph, rounds: int = 100, fixed: int | None = None) -> DataFrame:
    """node_id, n_reactions, n_pathways, degree, pagerank, branch_score = ln(1 + n_pathways) x pagerank of every metabolite.

    PageRank runs over the undirected graph of metabolites and their reactions; without edges it is zero.
    """
    b = laid(met_reaction_pairs(g))
    mets = g.of_type("metabolite").select("node_id")
    count = b.groupBy("node_id").agg(F.count("*").alias("n_reactions"))
    rxn = g.of_type("reaction").select(F.col("node_id").alias("other"), F.explode("pathways").alias("p"))
    paths = b.join(rxn, "other").groupBy("node_id").agg(F.count_distinct("p").alias("n_pathways"))
    pairs = b.select(F.col("node_id").alias("src"), F.col("other").alias("dst"))
    pairs = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    if b.isEmpty():
        rank = mets.select("node_id", F.lit(0.0).alias("rank"))
    else:
        rank = pagerank(mets.unionByName(b.select(F.col("other").alias("node_id")).distinct()), pairs, rounds=rounds, fixed=fixed)
    out = mets.join(count, "node_id", "left").join(paths, "node_id", "left").join(rank, "node_id", "left")
    n, p, r = (F.coalesce(c, F.lit(0)) for c in ("n_reactions", "n_pathways", "rank"))
    return out.select("node_id", n.alias("n_reactions"), p.alias("n_pathways"), n.alias("degree"), r.alias("pagerank"), (F.log1p(p) * r).alias("branch_score"))


def targeted_sigma(real: DataFrame, permuted: DataFrame, target: DataFrame) -> DataFrame:
    """z of the target reactions' mean |p_up - p_down| against permutations: (reaction_id, p_up, p_down), the same with perm, (reaction_id)."""
    mean = F.avg(F.abs(F.col("p_up") - F.col("p_down"))).alias("m")
    r = real.join(target, "reaction_id", "left_semi").agg(mean.alias("observed"))
    p = permuted.join(target, "reaction_id", "left_semi").groupBy("perm").agg(mean).agg(F.avg("m").alias("null_mean"), F.stddev_samp("m").alias("null_sd"))
    z = F.when(F.col("null_sd") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_sd")).otherwise(F.lit(float("nan")))
    return r.crossJoin(p).withColumn("z", z)  # one row each


def reactions_in_pathways(g: Graph, pathways: list[str]) -> DataFrame:
    return g.of_type("reaction").where(F.arrays_overlap("pathways", F.array(*map(F.lit, pathways)))).select("node_id")


def reactions_catalysed_by(g: Graph, genes: list[str]) -> DataFrame:
    """By gene id or symbol (name)."""
    hit = g.of_type("gene").where(F.col("node_id").isin(genes) | F.col("name").isin(genes)).select(F.col("node_id").alias("src"))
    rxn = g.of_type("reaction").select(F.col("node_id").alias("dst"))
    return g.edges.join(hit, "src", "left_semi").join(rxn, "dst", "left_semi").select(F.col("dst").alias("node_id")).distinct()


def reactions_with_metabolite_in(g: Graph, mets: list[str]) -> DataFrame:
    s = g.edges.where((F.col("rel") == "substrate") & F.col("src").isin(mets)).select(F.col("dst").alias("node_id"))
    p = g.edges.where((F.col("rel") == "product") & F.col("dst").isin(mets)).select(F.col("src").alias("node_id"))
    return s.unionByName(p).distinct()


def composite_anchor(g: Graph, pathways: list[str], genes: list[str], mets: list[str]) -> DataFrame:
    """The union of the three selectors."""
    return reactions_in_pathways(g, pathways).unionByName(reactions_catalysed_by(g, genes)).unionByName(reactions_with_metabolite_in(g, mets)).distinct()


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison and show, zero without a sign; operators never round."""
    def c(name: str, kind: str) -> Column:
        return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name) if kind == "double" else F.col(name)

    return df.select(*(c(n, k) for n, k in df.dtypes))


def with_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
