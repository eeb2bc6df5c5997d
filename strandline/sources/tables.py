"""Tabular and line formats as DataFrames: evidence tables, cross references, interaction and annotation files.

Paths go to Spark's readers, so any store and any compression Spark knows will do.
Headers are found by aliases in a fixed order, whatever their case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as nm

#: Accepted headers, first match first.
ALIASES = {
    "feature_id": ("feature_id", "feature", "metabolite", "gene", "symbol", "protein", "name", "id"),
    "effect_size": ("effect_size", "log2_fc", "log2fc", "logfc", "log2foldchange", "fold_change", "effect", "beta"),
    "p_value": ("p_value", "pvalue", "p", "pval", "p.value"),
    "fdr": ("fdr", "p_adj", "padj", "q_value", "qvalue", "adj.p.val"),
    "sample_id": ("sample_id", "sample"),
    "notes": ("notes", "note", "comment"),
}


def renamed(df: DataFrame, aliases: dict[str, tuple[str, ...]] = ALIASES, needed: tuple[str, ...] = ("feature_id", "effect_size")) -> DataFrame:
    """The columns that aliases name, under their own names."""
    have = {c.lower().strip(): c for c in reversed(df.columns)}
    found = {k: next((have[a] for a in v if a in have), None) for k, v in aliases.items()}
    if missing := [k for k in needed if found[k] is None]:
        raise ValueError(f"no column for {missing} among {df.columns}")
    return df.select(*(F.col(f"`{c}`").alias(k) for k, c in found.items() if c is not None))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: str | None = None) -> DataFrame:
    """Everything as text unless a schema is given; fields may be quoted and span lines."""
    r = spark.read.option("sep", sep).option("header", header).option("quote", '"').option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def evidence(df: DataFrame, mapping: DataFrame | None = None, assay: str = "metabolomics", keep_unmapped: bool = True, p_most: float | None = None, fdr_most: float | None = None) -> DataFrame:
    """feature_id, node_id, effect_size, p_value, fdr, assay_type[, ...] of a table with known headers.

    Blank features and effects that aren't numbers go; rows over a threshold go only
    where they have that value. mapping: (feature_id, node_id, confidence), joined
    once, left (``keep_unmapped``) or inner.
    """
    d = renamed(df)
    d = d.withColumns({c: (nm.number(c) if c in ("effect_size", "p_value", "fdr") else nm.clean(c)) for c in d.columns})
    d = d.where("feature_id IS NOT NULL AND effect_size IS NOT NULL")
    for c, most in (("p_value", p_most), ("fdr", fdr_most)):
        if most is not None and c in d.columns:
            d = d.where(F.col(c).isNull() | (F.col(c) <= most))
    d = d.withColumn("assay_type", F.lit(assay))
    if mapping is None:
        return d
    return d.join(mapping.select("feature_id", "node_id", "confidence"), "feature_id", "left" if keep_unmapped else "inner")


def metanetx(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A table whose lines beginning with # are its preface."""
    t = spark.read.text(path).where("value <> '' AND NOT startswith(value, '#')")
    parts = F.split("value", "\t", -1)
    return t.select(*(F.nullif(F.get(parts, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(columns)))


def clinvar(df: DataFrame, least_stars: int = 1, assembly: str = "GRCh38") -> DataFrame:
    """variant_id, gene_symbol, significance, stars, kind of pathogenic variants: one row for each id."""
    stars = F.create_map(*(F.lit(x) for kv in {
        "practice guideline": 4, "reviewed by expert panel": 3, "criteria provided, multiple submitters, no conflicts": 2,
        "criteria provided, conflicting classifications": 1, "criteria provided, single submitter": 1,
    }.items() for x in kv))
    s = F.coalesce(F.try_element_at(stars, F.lower("ReviewStatus")), F.lit(0))
    rs = nm.clean(F.col("`RS# (dbSNP)`"))
    vid = F.when(rs.isNotNull() & (rs != "-1"), F.concat(F.lit("rs:"), rs)).otherwise(F.concat(F.lit("ClinVar:"), F.col("VariationID")))
    d = df.where((F.col("Assembly") == assembly) & F.lower("ClinicalSignificance").contains("pathogenic") & ~F.lower("ClinicalSignificance").contains("conflicting"))
    d = d.select(vid.alias("variant_id"), nm.clean("GeneSymbol").alias("gene_symbol"), F.col("ClinicalSignificance").alias("significance"), s.alias("stars"), F.col("Type").alias("kind"))
    d = d.where((F.col("stars") >= least_stars) & F.col("gene_symbol").isNotNull())
    best = F.max_by(F.struct(*d.columns), F.struct("stars", "gene_symbol", "significance", "kind"))
    return d.groupBy(F.col("variant_id").alias("k")).agg(best.alias("b")).select("b.*")


def ctd_genes(df: DataFrame, compounds: DataFrame, genes: DataFrame, organism: str = "Homo sapiens") -> DataFrame:
    """(src, dst, action, reference_count): chemical-gene rows (CasRN, GeneSymbol, Organism, InteractionActions, PubMedIDs) of known compounds (cas_id) and genes (symbol)."""
    d = df.where(F.col("Organism") == organism).select(nm.clean("CasRN").alias("cas_id"), F.upper("GeneSymbol").alias("k"), F.col("InteractionActions").alias("action"), F.size(F.filter(F.split(F.coalesce("PubMedIDs", F.lit("")), r"\|"), lambda x: x != "")).alias("reference_count"))
    c = compounds.where("cas_id IS NOT NULL").groupBy("cas_id").agg(F.min("node_id").alias("src"))
    g = genes.groupBy(F.upper("symbol").alias("k")).agg(F.min("node_id").alias("dst"))
    return d.join(c, "cas_id").join(g, "k").select("src", "dst", "action", "reference_count")


def gct(spark: SparkSession, path: str, least: float = 0.0) -> DataFrame:
    """(ensembl_id, symbol, tissue, tpm) of a wide expression table with two lines before its header; versions off ids, what isn't over zero left out."""
    lines = spark.read.text(path).where("value LIKE '%\t%\t%'")
    head = lines.where("startswith(value, 'Name\t')").first()[0].split("\t")
    parts = F.split("value", "\t")
    tissue = F.arrays_zip(F.array(*(F.lit(_tissue(t)) for t in head[2:])).alias("tissue"), F.slice(parts, 3, len(head) - 2).alias("tpm"))
    d = lines.where("NOT startswith(value, 'Name\t')").select(F.regexp_replace(parts[0], r"\.\d+$", "").alias("ensembl_id"), parts[1].alias("symbol"), F.explode(tissue).alias("t"))
    d = d.select("ensembl_id", "symbol", F.col("t.tissue").alias("tissue"), F.col("t.tpm").try_cast("double").alias("tpm"))
    return d.where((F.col("tpm") > 0) & (F.col("tpm") >= least))


def _tissue(raw: str) -> str:
    return "_".join(raw.lower().replace("(", " ").replace(")", " ").replace("-", " ").split())


def gtopdb(df: DataFrame, endogenous: bool = False, approved: bool = False, species: str = "Human") -> DataFrame:
    """(ligand, gene_symbol, action, affinity) of ligand-target rows; of several sub-units the first."""
    yes = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).isin("true", "yes", "1", "t")
    d = df.where(F.col("target_species") == species)
    d = d.where(yes("endogenous")) if endogenous else d
    d = d.where(yes("approved")) if approved else d
    return d.select("ligand", F.split("target_gene_symbol", r"\|")[0].alias("gene_symbol"), "action", nm.number("affinity").alias("affinity")).where("gene_symbol <> ''")


def t3db(df: DataFrame, index: DataFrame) -> DataFrame:
    """(toxin, node_id, ld50, ld50_unit): toxins to nodes by HMDB, ChEBI, CAS, PubChem, the first that hits; index: (kind, key, node_id)."""
    ids = F.array(*(F.struct(F.lit(i).alias("tier"), F.lit(k).alias("kind"), v.alias("key")) for i, (k, v) in enumerate((("hmdb", nm.hmdb("hmdb_id")), ("chebi", nm.chebi(F.concat(F.lit("CHEBI:"), F.col("chebi_id")))), ("cas", nm.clean("cas_number")), ("pubchem", nm.clean("pubchem_id"))))))
    hit = df.select("toxin", F.explode(ids).alias("t")).select("toxin", "t.*").join(index, ["kind", "key"]).groupBy("toxin").agg(F.min_by("node_id", "tier").alias("node_id"))
    num = F.regexp_extract("ld50_text", r"([\d.]+)\s*([A-Za-z]+(?:/[A-Za-z]+)?)", 1).try_cast("double")
    return df.join(hit, "toxin").select("toxin", "node_id", num.alias("ld50"), F.nullif(F.regexp_extract("ld50_text", r"([\d.]+)\s*([A-Za-z]+(?:/[A-Za-z]+)?)", 2), F.lit("")).alias("ld50_unit"))


def phenotype_genes(df: DataFrame) -> DataFrame:
    return df.where("hpo_id IS NOT NULL").select("hpo_id", F.concat(F.lit("symbol:"), "gene_symbol").alias("gene_id")).distinct()


def phenotype_diseases(df: DataFrame, to_mondo: DataFrame) -> DataFrame:
    """(hpo_id, disease_id): rows that aren't negated, ids mapped where they can be; to_mondo: (xref, mondo_id)."""
    d = df.where(F.coalesce(F.upper("qualifier"), F.lit("")) != "NOT")
    m = to_mondo.groupBy(F.col("xref").alias("database_id")).agg(F.min("mondo_id").alias("mondo_id"))
    return d.join(m, "database_id", "left").select("hpo_id", F.coalesce("mondo_id", "database_id").alias("disease_id")).distinct()


def mechanisms(df: DataFrame, genes: DataFrame) -> DataFrame:
    """(gene_id, drug_id, max_phase, action): one row for each gene and drug, at the highest phase."""
    g = genes.groupBy(F.upper("symbol").alias("k")).agg(F.min("node_id").alias("gene_id"))
    d = df.withColumn("k", F.upper("gene_symbol")).join(g, "k")
    return d.groupBy("gene_id", "drug_id").agg(F.max("max_phase").alias("max_phase"), F.max_by("action", F.struct("max_phase", "action")).alias("action"))


def associations(df: DataFrame, least: float = 0.1, most: int | None = None) -> DataFrame:
    """Disease-gene rows of a score of ``least`` or more; a cap per disease only where it is asked for."""
    d = df.where(F.col("score") >= least)
    if most is None:
        return d
    from ..graph import top_per

    return top_per(d, ["disease_id"], [F.desc("score"), F.asc("gene_id")], most).drop("rank")


def series_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((sample, field, value), (probe, sample, value)) of a series matrix: !Sample_ lines, and the table after !series_matrix_table_begin."""
    lines = spark.read.text(path)
    bare = lambda c: F.regexp_replace(c, '^"|"$', "")
    parts = F.split("value", "\t")
    samples = [x.strip('"') for x in lines.where("startswith(value, '\"ID_REF\"') OR startswith(value, 'ID_REF')").first()[0].split("\t")[1:]]
    names = F.array(*map(F.lit, samples))
    meta = lines.where("startswith(value, '!Sample_')").select(F.regexp_extract(parts[0], "!Sample_(.*)", 1).alias("field"), F.explode(F.arrays_zip(names.alias("sample"), F.slice(parts, 2, len(samples)).alias("v"))).alias("z"))
    data = lines.where("value NOT LIKE '!%' AND value LIKE '%\t%' AND NOT startswith(value, '\"ID_REF\"') AND NOT startswith(value, 'ID_REF')")
    data = data.select(bare(parts[0]).alias("probe"), F.explode(F.arrays_zip(names.alias("sample"), F.slice(parts, 2, len(samples)).alias("v"))).alias("z"))
    return meta.select("z.sample", "field", bare(F.col("z.v")).alias("value")), data.select("probe", "z.sample", F.col("z.v").try_cast("double").alias("value")).where("value IS NOT NULL")


def unpivoted(df: DataFrame, key: str, feature: str = "feature_id", value: str = "value") -> DataFrame:
    """A wide sample table in long form; what isn't a number is left out."""
    rest = [c for c in df.columns if c != key]
    return df.select(key, *(F.col(f"`{c}`").try_cast("double").alias(c) for c in rest)).unpivot(key, rest, feature, value).where(F.col(value).isNotNull())


