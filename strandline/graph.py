"""The property graph as two DataFrames, and relational operators over them.

``nodes``: node_id, node_type, and whatever attributes a source has. ``edges``:
src, dst, rel (the lower-cased role, or else the edge type), and attributes. At
most one edge stands between an ordered pair; ``upsert_edges`` lets the last
loaded win, as re-adding an edge overwrites it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Node types.
NODE_TYPES = ("metabolite", "reaction", "disease", "gene", "pathway", "phenotype", "drug", "variant", "microbial_taxon")


def flag(name: str) -> Column:
    """A boolean attribute; absent is false."""
    return F.coalesce(F.col(name), F.lit(False))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; attributes of ``new`` overwrite where they are given, attribute by attribute.

    Repeated keys inside ``new`` are taken in order of ``load_seq`` where it has that
    column. One shuffle, with partial aggregation.
    """
    seq = F.col("load_seq") if "load_seq" in new.columns else F.lit(0)
    a = old.drop("load_seq").withColumn("__seq", F.lit(-1).cast("long"))
    b = new.withColumn("__seq", seq.cast("long")).drop("load_seq")
    both = a.unionByName(b, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "__seq"]
    return both.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__seq"))).alias(c) for c in rest))


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    #: (node_id, other, rel): the edges between other nodes and reactions of ``nodes``, seen from the others, where a source knows them.
    at_reactions: DataFrame | None = None

    # -- scans ---------------------------------------------------------------
    def of_type(self, *types: str) -> DataFrame:
        return self.nodes.where(F.col("node_type").isin(*types))

    def currency_nodes(self) -> DataFrame:
        return self.nodes.where(flag("is_currency"))

    def reviewed_nodes(self) -> DataFrame:
        return self.nodes.where(flag("manually_reviewed"))

    def reviewed_edges(self) -> DataFrame:
        return self.edges.where(flag("manually_reviewed"))

    # -- writes --------------------------------------------------------------
    def upsert_nodes(self, new: DataFrame) -> Graph:
        return Graph(upsert(self.nodes, new, ["node_id"]), self.edges)

    def upsert_edges(self, new: DataFrame) -> Graph:
        return Graph(self.nodes, upsert(self.edges, new, ["src", "dst"]))

    def flag_currency(self, ids: DataFrame) -> Graph:
        """Flags the metabolites whose node_id is in ``ids``."""
        hit = ids.select("node_id").distinct().withColumn("__hit", F.lit(True))
        n = self.nodes.join(hit, "node_id", "left")
        now = flag("is_currency") | (flag("__hit") & (F.col("node_type") == "metabolite"))
        return Graph(n.withColumn("is_currency", now).drop("__hit"), self.edges)

    # -- restrictions ----------------------------------------------------------
    def induced(self, nodes: DataFrame) -> Graph:
        """Edges with both ends among ``nodes``: two semi-joins."""
        ids = nodes.select("node_id")
        e = self.edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
        return Graph(nodes, e.select(*self.edges.columns))

    def filter_by_species(self, species: str) -> Graph:
        """Nodes without species, or whose species begins so, whatever the case."""
        s = F.lower(F.coalesce("species", F.lit("")))
        return self.induced(self.nodes.where((s == "") | s.startswith(species.lower())))

    def both_ways(self) -> DataFrame:
        """(node_id, other, rel): every edge from either end."""
        e = self.edges.select("src", "dst", "rel")
        return e.select(F.col("src").alias("node_id"), F.col("dst").alias("other"), "rel").unionByName(
            e.select(F.col("dst").alias("node_id"), F.col("src").alias("other"), "rel")
        )

    def neighbours(self, ids: DataFrame, kind: str) -> DataFrame:
        """(node_id, other): distinct neighbours of a type, in either direction."""
        typed = self.of_type(kind).select(F.col("node_id").alias("other"))
        return self.both_ways().join(ids.select("node_id"), "node_id", "left_semi").join(typed, "other", "left_semi").select("node_id", "other").distinct()

    def metabolite_subgraph(self, ids: DataFrame) -> Graph:
        """The metabolites given and the reactions all of whose metabolites are given, with the edges among them."""
        mets = self.of_type("metabolite").join(ids.select("node_id").distinct(), "node_id", "left_semi")
        rxn = self.of_type("reaction")
        given = mets.select(F.col("node_id").alias("other"), F.lit(True).alias("given"))
        touched = (
            self.neighbours(rxn, "metabolite")
            .join(given, "other", "left")
            .groupBy("node_id")
            .agg(F.bool_and(flag("given")).alias("whole"))
            .where("whole")
        )
        return self.induced(mets.unionByName(rxn.join(touched, "node_id", "left_semi").select(*mets.columns)))

    def noncurrency(self) -> Graph:
        """Other than currency metabolites, and reactions that keep one on both sides."""
        mets = self.of_type("metabolite").where(~flag("is_currency"))
        ids = mets.select("node_id")
        left = self.edges.where("rel = 'substrate'").join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").select(F.col("dst").alias("node_id"))
        right = self.edges.where("rel = 'product'").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(F.col("src").alias("node_id"))
        rxn = self.of_type("reaction").join(left, "node_id", "left_semi").join(right, "node_id", "left_semi")
        return self.induced(mets.unionByName(rxn.select(*mets.columns)))

    # -- aggregates ------------------------------------------------------------
    def summary(self) -> DataFrame:
        """metric, value: nodes by type, flagged nodes, edges; one pass over each table."""
        counts = [F.count_if(F.col("node_type") == t).alias(t) for t in NODE_TYPES]
        counts += [F.count("*").alias("nodes"), F.count_if(flag("is_currency")).alias("currency")]
        one = self.nodes.agg(*counts).crossJoin(self.edges.agg(F.count("*").alias("edges")))
        return one.unpivot([], [*NODE_TYPES, "nodes", "currency", "edges"], "metric", "value")

    def reaction_degree(self) -> DataFrame:
        """node_id, degree: edges between a metabolite and reactions, in and out, one at least."""
        met = self.of_type("metabolite").select("node_id")
        near = self.at_reactions
        if near is None:
            near = self.both_ways().join(self.of_type("reaction").select(F.col("node_id").alias("other")), "other", "left_semi")
        d = near.groupBy("node_id").agg(F.count("*").alias("degree"))
        return met.join(d, "node_id", "left").select("node_id", F.greatest(F.coalesce("degree", F.lit(0)), F.lit(1)).alias("degree"))

    def total_degree(self) -> DataFrame:
        """node_id, degree over all edges, in and out."""
        return self.both_ways().groupBy("node_id").agg(F.count("*").alias("degree"))

    # -- pathways ----------------------------------------------------------------
    def promote_pathways(self) -> Graph:
        """Pathway nodes for the reactions' pathway lists, and edges pathway -> reaction that aren't there yet."""
        member = self.of_type("reaction").select(F.explode("pathways").alias("pathway"), "node_id").where("pathway <> ''").distinct()
        new = member.select(F.col("pathway").alias("node_id")).distinct().withColumn("node_type", F.lit("pathway")).withColumn("name", F.col("node_id"))
        fresh = new.join(self.nodes.select("node_id"), "node_id", "left_anti")
        e = member.select(F.col("pathway").alias("src"), F.col("node_id").alias("dst"), F.lit("pathway_reaction").alias("rel"))
        e = e.join(self.edges.select("src", "dst"), ["src", "dst"], "left_anti")
        return Graph(self.nodes.unionByName(fresh, allowMissingColumns=True), self.edges.unionByName(e, allowMissingColumns=True))

    def pathway_nodes(self, least: int = 3, most: int = 500) -> DataFrame:
        """pathway_id, node_id: distinct metabolites and genes next to a pathway's reactions, where there are ``least`` to ``most``."""
        member = self.of_type("reaction").select("node_id", F.explode("pathways").alias("pathway_id"))
        typed = self.of_type("metabolite", "gene").select(F.col("node_id").alias("other"))
        near = self.both_ways().join(typed, "other", "left_semi").join(member, "node_id")
        near = near.select("pathway_id", F.col("other").alias("node_id")).distinct()
        size = near.groupBy("pathway_id").agg(F.count("*").alias("size")).where(F.col("size").between(least, most))
        return near.join(size.select("pathway_id"), "pathway_id")

    # -- compartments --------------------------------------------------------------
    def compartment_summary(self) -> DataFrame:
        return self.of_type("metabolite").groupBy(compartment_of().alias("compartment")).agg(F.count("*").alias("n"))

    def with_compartments(self) -> Graph:
        """Metabolites without a compartment get that of their id, if it has one."""
        parsed = F.nullif(F.regexp_extract("node_id", "^[^@]*@(.*)$", 1), F.lit(""))
        c = F.when(F.col("node_type") == "metabolite", F.coalesce(F.nullif(F.col("compartment"), F.lit("")), parsed)).otherwise(F.col("compartment"))
        return Graph(self.nodes.withColumn("compartment", c), self.edges)

    def same_compartment(self, compartment: str) -> Graph:
        """Metabolites of one compartment, and all other nodes."""
        return self.induced(self.nodes.where((F.col("node_type") != "metabolite") | (compartment_of() == compartment)))

    def collapse_compartments(self) -> Graph:
        """One node for each base id (that with a chebi_id rather, then the smallest id), edges rewritten, loops dropped, the surest edge kept."""
        base = F.substring_index(F.col("node_id"), "@", 1)
        best = F.min_by(F.struct(*self.nodes.columns), F.struct(F.col("chebi_id").isNull(), "node_id"))
        n = self.nodes.groupBy(base.alias("base")).agg(best.alias("n")).select(F.col("base").alias("node_id"), *(F.col(f"n.{c}") for c in self.nodes.columns if c != "node_id"))
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        e = self.edges.withColumns({"src": F.substring_index("src", "@", 1), "dst": F.substring_index("dst", "@", 1)}).where("src <> dst")
        top = F.max_by(F.struct(*rest), F.struct(F.coalesce("confidence", F.lit(0.0)), "rel"))
        e = e.groupBy("src", "dst").agg(top.alias("e")).select("src", "dst", "e.*")
        return Graph(n, e)


def compartment_of() -> Column:
    """The attribute, else what follows the id's first @, else "(none)"."""
    return F.coalesce(F.nullif(F.col("compartment"), F.lit("")), F.nullif(F.regexp_extract("node_id", "^[^@]*@(.*)$", 1), F.lit("")), F.lit("(none)"))


def metabolites_for_pathways(g: Graph, pathways: Iterable[str]) -> DataFrame:
    """node_id, n_pathways, pathways: substrates and products of reactions in any of the pathways."""
    want = [F.lit(p) for p in pathways]
    hit = g.of_type("reaction").select("node_id", F.explode(F.array_intersect("pathways", F.array(*want))).alias("pathway"))
    sides = g.edges.where(F.col("rel").isin("substrate", "product"))
    ends = sides.select(F.col("src").alias("node_id"), F.col("dst").alias("met")).unionByName(sides.select(F.col("dst").alias("node_id"), F.col("src").alias("met")))
    mets = g.of_type("metabolite").select(F.col("node_id").alias("met"))
    return (
        ends.join(hit, "node_id")
        .join(mets, "met", "left_semi")
        .groupBy(F.col("met").alias("node_id"))
        .agg(F.count_distinct("pathway").alias("n_pathways"), F.array_join(F.array_sort(F.collect_set("pathway")), ";").alias("pathways"))
    )


def search_nodes(g: Graph, text: str, most: int = 80) -> DataFrame:
    """Nodes whose id or name holds the text, whatever the case; a capped report, in order of id."""
    t = text.lower()
    hit = F.lower("node_id").contains(t) | F.lower(F.coalesce("name", F.lit(""))).contains(t)
    return g.nodes.where(hit).orderBy("node_id").limit(most)


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key (row_number gives a group limit below the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
