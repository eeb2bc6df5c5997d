"""Enrichment of nodes and edges from lookup tables: synonyms, hazards, orthologs, communities, literature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as nm
from ..graph import Graph, top_per



def merged(old: Column, new: Column) -> Column:
    """A sorted union of two text arrays; null where both are."""
    none = F.array().cast("array<string>")
    return F.when(old.isNotNull() | new.isNotNull(), F.array_sort(F.array_distinct(F.concat(F.coalesce(old, none), F.coalesce(new, none)))))


def add_synonyms(nodes: DataFrame, table: DataFrame, key: str, most: int = 50) -> DataFrame:
    """``synonyms`` joined by ``key`` (key, synonym, place): lower-cased, the first ``most`` of a key, in sorted union with those there."""
    t = table.select(key, F.lower(F.trim("synonym")).alias("s"), "place").where("s <> ''").groupBy(key, "s").agg(F.min("place").alias("place"))
    t = top_per(t, [key], [F.asc("place"), F.asc("s")], most).groupBy(key).agg(F.collect_set("s").alias("__s"))
    n = nodes.join(t, key, "left")
    old = F.transform(F.col("synonyms"), lambda s: F.lower(s)) if "synonyms" in nodes.columns else F.lit(None).cast("array<string>")
    return n.withColumn("synonyms", merged(old, F.col("__s"))).drop("__s")


def add_hazards(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """(inchikey, cas_id, dtxsid, flags) onto nodes: ids fill what is missing, flags are united and sorted."""
    t = table.groupBy("inchikey").agg(F.min("cas_id").alias("__c"), F.min("dtxsid").alias("__d"), F.array_distinct(F.flatten(F.collect_list("flags"))).alias("__f"))
    n = nodes.join(t, "inchikey", "left")
    have = lambda c, kind: F.col(c) if c in nodes.columns else F.lit(None).cast(kind)
    return n.withColumns({"cas_id": F.coalesce(nm.clean(have("cas_id", "string")), "__c"), "dtxsid": F.coalesce(nm.clean(have("dtxsid", "string")), "__d"), "hazards": merged(have("hazards", "array<string>"), F.col("__f"))}).drop("__c", "__d", "__f")


def orthologs(pairs: DataFrame, genes: DataFrame, source: str, target: str) -> DataFrame:
    """(symbol, target_symbol) through gene ids: pairs (tax_a, gene_a, tax_b, gene_b) either way round, genes (tax_id, gene_id, symbol); the smallest of several."""
    p = pairs.select("tax_a", "gene_a", "tax_b", "gene_b")
    p = p.unionByName(p.select(F.col("tax_b").alias("tax_a"), F.col("gene_b").alias("gene_a"), F.col("tax_a").alias("tax_b"), F.col("gene_a").alias("gene_b")))
    p = p.where((F.col("tax_a") == source) & (F.col("tax_b") == target)).select("gene_a", "gene_b").distinct()
    a = genes.where(F.col("tax_id") == source).select(F.col("gene_id").alias("gene_a"), "symbol")
    b = genes.where(F.col("tax_id") == target).select(F.col("gene_id").alias("gene_b"), F.col("symbol").alias("target_symbol"))
    return p.join(a, "gene_a").join(b, "gene_b").groupBy(F.upper("symbol").alias("symbol")).agg(F.min("target_symbol").alias("target_symbol"))


def vmh_ids(nodes: DataFrame, by_hmdb: DataFrame, by_pubchem: DataFrame) -> DataFrame:
    """``vmh_id`` by HMDB id, else by PubChem id; tables (hmdb_id or pubchem_cid, abbreviation)."""
    h = by_hmdb.groupBy(nm.hmdb("hmdb_id").alias("__h")).agg(F.min("abbreviation").alias("__a"))
    p = by_pubchem.groupBy(F.col("pubchem_cid").cast("string").alias("__p")).agg(F.min("abbreviation").alias("__b"))
    n = nodes.join(h, nm.hmdb("hmdb_id") == F.col("__h"), "left").join(p, F.col("pubchem_cid").cast("string") == F.col("__p"), "left")
    old = nm.clean("vmh_id") if "vmh_id" in nodes.columns else F.lit(None).cast("string")
    return n.withColumn("vmh_id", F.coalesce(old, "__a", "__b")).drop("__h", "__a", "__p", "__b")


def genes_of_reactions(g: Graph) -> Graph:
    """Gene nodes symbol:X for the reactions' gene_symbols and catalysis edges; a gene that was there gets gene_reaction; no edge is overwritten."""
    m = g.of_type("reaction").select(F.col("node_id").alias("dst"), F.explode("gene_symbols").alias("s")).where("s <> ''")
    m = m.select("dst", F.upper("s").alias("symbol")).distinct()
    there = g.of_type("gene").where("symbol IS NOT NULL").groupBy(F.upper("symbol").alias("symbol")).agg(F.min("node_id").alias("id"))
    m = m.join(there, "symbol", "left")
    new = m.where("id IS NULL").select(F.concat(F.lit("symbol:"), "symbol").alias("node_id"), F.lit("gene").alias("node_type"), F.col("symbol").alias("name"), "symbol").distinct()
    e = m.select(F.coalesce("id", F.concat(F.lit("symbol:"), "symbol")).alias("src"), "dst", F.when(F.col("id").isNull(), "catalysis").otherwise("gene_reaction").alias("rel"))
    e = e.join(g.edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return Graph(g.nodes.unionByName(new, allowMissingColumns=True), g.edges.unionByName(e, allowMissingColumns=True))


def community(exchanges: DataFrame, abundance: DataFrame, vmh: DataFrame, least: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(taxa, edges, unresolved) of a microbial community.

    exchanges: (taxon, vmh_met, reaction, role, weight); abundance: (taxon, sample_id,
    value); vmh: (vmh_id, node_id). Taxa of a mean abundance under ``least`` go. An
    edge has the largest weight of its reactions, the samples' abundances, and its
    role where all reactions agree (else bidirectional).
    """
    taxa = abundance.groupBy("taxon").agg(F.avg("value").alias("mean_abundance"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("sample_id", "value")))).alias("sample_abundances")).where(F.col("mean_abundance") >= least)
    taxa = taxa.select(F.concat(F.lit("taxon:"), F.regexp_replace(F.lower("taxon"), r"\s+", "_")).alias("node_id"), F.lit("microbial_taxon").alias("node_type"), "taxon", "mean_abundance", "sample_abundances")
    x = exchanges.withColumn("vmh_id", F.regexp_replace("vmh_met", r"(\[[a-z]\]|\([a-z]\)|_[ecu])$", "")).join(taxa.select("taxon", "node_id"), "taxon")
    index = vmh.groupBy("vmh_id").agg(F.min("node_id").alias("dst"))
    j = x.join(index, "vmh_id", "left")
    unresolved = j.where("dst IS NULL").select("vmh_id").distinct()
    e = j.where("dst IS NOT NULL").groupBy(F.col("node_id").alias("src"), "dst").agg(
        F.max("weight").alias("weight"), F.when(F.count_distinct("role") == 1, F.first("role")).otherwise(F.lit("bidirectional")).alias("role"), F.array_sort(F.collect_set("reaction")).alias("reactions")
    )
    return taxa, e, unresolved


def capacity(members: DataFrame, edges: DataFrame, missing_as_zero: bool = True) -> DataFrame:
    """(pathway_id, weight): mean over members of their largest edge weight, with zeros for those without (or over those with one)."""
    w = edges.groupBy(F.col("dst").alias("node_id")).agg(F.max("weight").alias("w"))
    m = members.join(w, "node_id", "left")
    return m.groupBy("pathway_id").agg(F.avg(F.coalesce("w", F.lit(0.0)) if missing_as_zero else F.col("w")).alias("weight"))


def concordance(metabolites: DataFrame, microbes: DataFrame, cut: float = 0.5) -> DataFrame:
    """(pathway_id, label): both scaled to 0..1 over pathways; active, silent, exogenous or absent by which are over ``cut``."""
    def scaled(d: DataFrame, name: str) -> DataFrame:
        r = d.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
        return d.crossJoin(r).select("pathway_id", F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias(name))  # one row

    j = scaled(metabolites, "m").join(scaled(microbes, "c"), "pathway_id", "full").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("m", "c")})
    up, able = F.col("m") >= cut, F.col("c") >= cut
    return j.select("pathway_id", "m", "c", F.when(up & able, "active").when(able, "silent").when(up, "exogenous").otherwise("absent").alias("label"))


def chemical_hits(articles: DataFrame, generic: tuple[str, ...] = ("water", "oxygen", "drug", "acid")) -> DataFrame:
    """(chemical, n_articles): each chemical once an article; generic terms left out. articles: (pmid, chemicals)."""
    c = articles.select("pmid", F.explode("chemicals").alias("c")).select("pmid", F.lower(F.trim("c")).alias("chemical")).where(~F.col("chemical").isin(list(generic)) & (F.col("chemical") != ""))
    return c.groupBy("chemical").agg(F.count_distinct("pmid").alias("n_articles"))


def literature_nodes(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, n_articles, chemicals): hits matched to names and synonyms, summed over a node."""
    names = F.array_distinct(F.filter(F.concat(F.array(F.lower("name")), F.coalesce(F.transform("synonyms", lambda s: F.lower(s)), F.array().cast("array<string>"))), lambda s: s.isNotNull()))
    n = nodes.where("node_type = 'metabolite'").select("node_id", F.explode(names).alias("chemical")).distinct()
    return hits.join(n, "chemical").groupBy("node_id").agg(F.sum("n_articles").alias("n_articles"), F.array_join(F.array_sort(F.collect_set("chemical")), ";").alias("chemicals"))


def last_rows(table: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in order."""
    rest = [c for c in table.columns if c != key]
    return table.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def overridden(auto: DataFrame, manual: DataFrame, key: str, value: str, excluded: DataFrame | None = None) -> DataFrame:
    """Automatic values with manual ones over them, and what is excluded left out."""
    m = manual.groupBy(key).agg(F.max(value).alias("__m"))
    d = auto.join(m, key, "full").withColumn(value, F.coalesce("__m", value)).drop("__m")
    return d if excluded is None else d.join(excluded.select(key), key, "left_anti")


def unannotatable(g: Graph, dictionary: DataFrame) -> DataFrame:
    """Metabolites flagged whose dictionary entry has neither InChIKey nor PubChem id; joined on names with blanks as _."""
    k = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")
    bare = dictionary.groupBy(k(F.col("BIOCHEMICAL")).alias("__k")).agg(F.bool_and(nm.clean("INCHIKEY").isNull() & nm.clean("PUBCHEM").isNull()).alias("__u"))
    m = g.of_type("metabolite")
    return m.join(bare, k(F.col("name")) == F.col("__k"), "left").withColumn("unannotatable", F.coalesce("__u", F.lit(False))).drop("__k", "__u")
