"""Entity resolution: identifiers and names to nodes through ordered tiers of equi-joins.

An index lists every key of every node, the best node for a key first; a feature
lists the keys it may match, by tier. One join on (kind, key) and one aggregation
resolve any number of features: no lookup loops, no UDF but for the fuzzy tier.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as nm
from ..graph import Graph

_KEY = "array<struct<kind:string,key:string>>"


def _keys(*pairs: tuple[str, Column]) -> Column:
    """Structs of kind and key where the key isn't null."""
    return F.filter(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in pairs)), lambda s: s["key"].isNotNull())


def metabolite_index(g: Graph) -> DataFrame:
    """(kind, key, node_id): for every key the node of the best bucket (reaction-connected without compartment, connected, orphan, orphan with compartment), then of the smallest id."""
    m = g.of_type("metabolite")
    col = lambda n: nm.clean(n) if n in m.columns else F.lit(None).cast("string")
    linked = g.both_ways().join(g.of_type("reaction").select(F.col("node_id").alias("other")), "other", "left_semi").select("node_id").distinct().withColumn("linked", F.lit(True))
    m = m.join(linked, "node_id", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    placed = F.col("node_id").contains("@")
    bucket = F.when(F.col("linked") & ~placed, 0).when(F.col("linked"), 1).when(~placed, 2).otherwise(3)
    name = F.regexp_replace(col("name"), r"\s*\[[^\[\]]+\]\s*$", "")
    said = F.transform(F.flatten(F.array(nm.split_variants(name), nm.salt_variants(name), F.array(nm.without_stereo(name)))), lambda s: F.lower(s))
    ids = _keys(
        ("id", F.col("node_id")), ("chebi", nm.chebi(F.coalesce(col("chebi_id"), F.col("node_id")))), ("hmdb", nm.hmdb(col("hmdb_id"))), ("vmh", F.lower(col("vmh_id"))),
        ("inchikey", nm.inchikey(col("inchikey"))), ("connectivity", nm.connectivity(col("inchikey"))), ("pubchem", nm.pubchem(col("pubchem_cid"))),
    )
    both = F.concat(ids.cast(_KEY), F.transform(F.filter(said, lambda s: s.isNotNull() & (s != "")), lambda s: F.struct(F.lit("name").alias("kind"), s.alias("key"))).cast(_KEY))
    rows = m.select("node_id", bucket.alias("bucket"), F.explode(both).alias("k"))
    return rows.groupBy("k.kind", "k.key").agg(F.min_by("node_id", F.struct("bucket", "node_id")).alias("node_id"))


#: Tiers of a metabolite feature, in order, with their confidence.
TIERS = (("id", 1.0), ("chebi", 1.0), ("hmdb", 1.0), ("vmh", 1.0), ("inchikey", 1.0), ("connectivity", 0.9), ("pubchem", 0.85), ("name", 1.0), ("salt", 0.95), ("fuzzy", 0.75))


def map_metabolites(features: DataFrame, index: DataFrame) -> DataFrame:
    """(feature_id, node_id, confidence, tier) of every distinct feature; ids joined by ; or | take their surest part (the first of equals). Nulls where nothing matches."""
    f = features.select("feature_id").where("feature_id IS NOT NULL").distinct()
    part = f.select("feature_id", F.posexplode(F.split("feature_id", r"[;|]")).alias("at", "one")).withColumn("one", F.trim("one")).where("one <> ''")
    one = F.col("one")
    forms = {
        "id": one, "chebi": nm.chebi(one), "hmdb": nm.hmdb(one), "vmh": F.lower(one), "inchikey": nm.inchikey(one), "connectivity": nm.connectivity(one), "pubchem": nm.pubchem(one), "name": F.lower(one),
    }
    tier = {k: i for i, (k, _) in enumerate(TIERS)}
    conf = dict(TIERS)
    made = [F.struct(F.lit(tier[k]).alias("tier"), F.lit(conf[k]).alias("confidence"), F.lit(k).alias("kind"), v.alias("key")) for k, v in forms.items()]
    salts = F.transform(nm.salt_variants(one), lambda s: F.struct(F.lit(tier["salt"]).alias("tier"), F.lit(conf["salt"]).alias("confidence"), F.lit("name").alias("kind"), s.alias("key")))
    tries = part.select("feature_id", "at", F.explode(F.concat(F.array(*made), salts)).alias("t")).select("feature_id", "at", "t.*").where("key IS NOT NULL")
    hit = tries.join(index, ["kind", "key"])
    by_part = hit.groupBy("feature_id", "at").agg(F.min_by(F.struct("node_id", "confidence", "tier"), F.struct("tier", "key")).alias("b"))
    best = by_part.groupBy("feature_id").agg(F.max_by("b", F.struct("b.confidence", -F.col("at"))).alias("b"))
    named = F.element_at(F.array(*(F.lit(k) for k, _ in TIERS)), F.col("b.tier") + 1)
    return f.join(best, "feature_id", "left").select("feature_id", "b.node_id", "b.confidence", F.when(F.col("b.node_id").isNotNull(), named).alias("tier"))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def fuzzy(features: DataFrame, index: DataFrame, least: float = 0.85, gram: int = 5) -> DataFrame:
    """(feature_id, node_id, confidence): names of five letters or more that share a five-letter run; the best ratio of ``least`` or more.

    Blocking is an equi-join on runs, so only pairs with a common run are ever compared.
    """
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - gram + 1), lambda i: F.substring(c, i, F.lit(gram))))
    f = features.select("feature_id", F.lower("feature_id").alias("a")).distinct().where(F.length("a") >= gram)
    n = index.where(F.col("kind") == "name").select("node_id", F.col("key").alias("b")).where(F.length("b") >= gram)
    pairs = f.select("*", F.explode(runs(F.col("a"))).alias("run")).join(n.select("*", F.explode(runs(F.col("b"))).alias("run")), "run").select("feature_id", "a", "node_id", "b").distinct()
    # ratio = 2m / (|a| + |b|) with m at most the shorter: a bound that needs no comparison
    close = pairs.where(2.0 * F.least(F.length("a"), F.length("b")) / (F.length("a") + F.length("b")) >= least).withColumn("r", similarity("a", "b"))
    best = close.where(F.col("r") >= least).groupBy("feature_id").agg(F.min_by(F.struct("node_id", "r"), F.struct(-F.col("r"), "b", "node_id")).alias("x"))
    return best.select("feature_id", "x.node_id", F.least(F.lit(0.95), F.col("x.r")).alias("confidence"))


def gene_index(g: Graph) -> DataFrame:
    m = g.of_type("gene")
    col = lambda n: nm.clean(n) if n in m.columns else F.lit(None).cast("string")
    keys = _keys(("id", F.col("node_id")), ("symbol", F.upper(col("symbol"))), ("ensembl", F.regexp_replace(F.upper(col("ensembl_id")), r"\.\d+$", "")), ("hgnc", F.upper(col("hgnc_id"))))
    return m.select("node_id", F.explode(keys).alias("k")).groupBy("k.kind", "k.key").agg(F.min("node_id").alias("node_id"))


def map_genes(features: DataFrame, index: DataFrame) -> DataFrame:
    """(feature_id, node_id, confidence): node id, then symbol:, ENSG and HGNC forms alone, else a bare symbol at 0.95."""
    f = features.select("feature_id").where("feature_id IS NOT NULL").distinct()
    u = F.upper(F.trim("feature_id"))
    kind = F.when(u.startswith("SYMBOL:"), "symbol").when(u.startswith("ENSG"), "ensembl").when(u.startswith("HGNC:"), "hgnc").otherwise("symbol")
    key = F.when(u.startswith("SYMBOL:"), F.substring(u, 8, 1000)).when(u.startswith("ENSG"), F.regexp_replace(u, r"\.\d+$", "")).otherwise(u)
    conf = F.when(u.startswith("SYMBOL:") | u.startswith("ENSG") | u.startswith("HGNC:"), 1.0).otherwise(0.95)
    t = f.select("feature_id", F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.lit(1.0).alias("confidence"), F.lit("id").alias("kind"), F.trim("feature_id").alias("key")), F.struct(F.lit(1).alias("tier"), conf.alias("confidence"), kind.alias("kind"), key.alias("key")))).alias("t"))
    hit = t.select("feature_id", "t.*").join(index, ["kind", "key"]).groupBy("feature_id").agg(F.min_by(F.struct("node_id", "confidence"), "tier").alias("b"))
    return f.join(hit, "feature_id", "left").select("feature_id", "b.node_id", "b.confidence")


#: Forms of clinical codes and the confidence of their tier.
CLINICAL = (("icd10", r"^[A-Z]\d{2}(\.?\w{1,4})?$", 1.0), ("icd9", r"^\d{3}(\.\d{1,2})?$", 0.9), ("hp", r"^HP:\d+$", 1.0), ("mondo", r"^MONDO:\d+$", 1.0), ("omim", r"^OMIM:\d+$", 1.0), ("orphanet", r"^(ORPHA|ORPHANET):\d+$", 1.0), ("loinc", r"^\d{1,5}-\d$", 0.9))


def map_clinical(features: DataFrame, xrefs: DataFrame) -> DataFrame:
    """(feature_id, node_id, confidence) by code form, dots left out; xrefs: (kind, key, node_id)."""
    f = features.select("feature_id").where("feature_id IS NOT NULL").distinct()
    u = F.upper(F.trim("feature_id"))
    t = f.select("feature_id", F.explode(F.array(*(F.when(u.rlike(p), F.struct(F.lit(i).alias("tier"), F.lit(c).alias("confidence"), F.lit(k).alias("kind"), F.replace(u, F.lit("."), F.lit("")).alias("key"))) for i, (k, p, c) in enumerate(CLINICAL)))).alias("t"))
    x = xrefs.select("kind", F.replace(F.upper("key"), F.lit("."), F.lit("")).alias("key"), "node_id").groupBy("kind", "key").agg(F.min("node_id").alias("node_id"))
    hit = t.where("t IS NOT NULL").select("feature_id", "t.*").join(x, ["kind", "key"]).groupBy("feature_id").agg(F.min_by(F.struct("node_id", "confidence"), "tier").alias("b"))
    return f.join(hit, "feature_id", "left").select("feature_id", "b.node_id", "b.confidence")


def with_fallback(features: DataFrame, mapper) -> DataFrame:
    """(feature_id, node_id, confidence): ``mapper`` on every candidate name; the surest (of equals the earliest) wins, other than the first at 0.1 less and 0.7 at least."""
    c = features.select("feature_id").distinct().select("feature_id", F.posexplode(nm.candidates("feature_id")).alias("at", "name"))
    got = mapper(c.select(F.col("name").alias("feature_id"))).withColumnRenamed("feature_id", "name")
    d = c.join(got.where("node_id IS NOT NULL"), "name")
    conf = F.when(F.col("at") == 0, F.col("confidence")).otherwise(F.greatest(F.lit(0.7), F.col("confidence") - 0.1))
    best = d.withColumn("confidence", conf).groupBy("feature_id").agg(F.max_by(F.struct("node_id", "confidence"), F.struct("confidence", -F.col("at"))).alias("b"))
    return features.select("feature_id").distinct().join(best, "feature_id", "left").select("feature_id", "b.node_id", "b.confidence")


def all_compartments(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, twin): all nodes of equal connectivity, itself first."""
    n = nodes.where("node_type = 'metabolite'").select("node_id", F.substring("inchikey", 1, 14).alias("k")).where("k <> ''")
    return ids.select("node_id").join(n, "node_id").join(n.select("k", F.col("node_id").alias("twin")), "k").select("node_id", "twin", (F.col("twin") == F.col("node_id")).alias("own"))


def via_hub(xref: DataFrame, left: str, right: str) -> DataFrame:
    """(left_id, right_id) through a shared hub id: (source 'prefix:value', hub, seq); the first in order of seq wins."""
    side = lambda p, name: xref.where(F.lower("source").startswith(p + ":")).select("hub", F.substring_index("source", ":", -1).alias(name), F.col("seq").alias("s_" + name))
    j = side(left, "left_id").join(side(right, "right_id"), "hub")
    return j.groupBy("left_id").agg(F.min_by("right_id", F.struct("s_left_id", "s_right_id")).alias("right_id"))


def fill_missing(nodes: DataFrame, column: str, *routes: tuple[DataFrame, str, str]) -> DataFrame:
    """``column`` filled where it is null or blank, by routes in order: (table, node key, table value)."""
    out, made = nodes, []
    for i, (t, key, value) in enumerate(routes):
        first = t.groupBy(key).agg(F.min(value).alias(f"__r{i}")).withColumnRenamed(key, f"__k{i}")
        out = out.join(first, F.col(key) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        made.append(F.col(f"__r{i}"))
    return out.withColumn(column, F.coalesce(nm.clean(column), *made)).drop(*(f"__r{i}" for i in range(len(routes))))


def collapse_twins(g: Graph, fields: list[str]) -> Graph:
    """Metabolites without reactions merge into a connected twin: by connectivity, ChEBI, name, then loose name; the twin's missing fields are filled, edges rewired without overwriting."""
    m = g.of_type("metabolite")
    linked = g.both_ways().join(g.of_type("reaction").select(F.col("node_id").alias("other")), "other", "left_semi").select("node_id").distinct()
    live, orphan = m.join(linked, "node_id", "left_semi"), m.join(linked, "node_id", "left_anti")
    has = lambda c: F.col(c) if c in m.columns else F.lit(None).cast("string")
    loose = F.regexp_replace(F.lower(nm.without_stereo(has("name"))), r"[^a-z0-9]", "")
    tiers = [F.substring(has("inchikey"), 1, 14), nm.chebi(F.coalesce(has("chebi_id"), F.lit(""))), F.lower(has("name")), loose]
    key = lambda d: d.select("node_id", F.posexplode(F.array(*tiers)).alias("tier", "key")).where("key IS NOT NULL AND key <> ''")
    best = key(live).groupBy("tier", "key").agg(F.min("node_id").alias("twin"))
    twin = key(orphan).join(best, ["tier", "key"]).groupBy("node_id").agg(F.min_by("twin", "tier").alias("twin"))
    gift = orphan.join(twin, "node_id").groupBy("twin").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("node_id"))).alias(f"__{c}") for c in fields)).withColumnRenamed("twin", "node_id")
    n = g.nodes.join(twin.select("node_id"), "node_id", "left_anti").join(gift, "node_id", "left")
    n = n.withColumns({c: F.coalesce(c, f"__{c}") for c in fields}).drop(*(f"__{c}" for c in fields))
    t = twin.select(F.col("node_id").alias("__old"), F.col("twin").alias("__new"))
    e = g.edges.join(t, F.col("src") == F.col("__old"), "left").withColumn("src2", F.coalesce("__new", "src")).drop("__old", "__new")
    e = e.join(t, F.col("dst") == F.col("__old"), "left").withColumn("dst2", F.coalesce("__new", "dst")).drop("__old", "__new")
    own = ((F.col("src") == F.col("src2")) & (F.col("dst") == F.col("dst2"))).cast("int")
    w = Window.partitionBy("src2", "dst2").orderBy(own.desc(), "src", "dst")
    e = e.withColumn("__n", F.row_number().over(w)).where("__n = 1 AND src2 <> dst2")
    return Graph(n, e.select(*(F.col(c + "2").alias(c) if c in ("src", "dst") else F.col(c) for c in g.edges.columns)))


def link_genes(g: Graph, mentions: DataFrame) -> DataFrame:
    """(src, dst, rel) catalysis edges that aren't there yet, for (reaction_id, symbol) mentions; of genes of one symbol the largest id wins."""
    genes = g.of_type("gene").groupBy(F.upper("symbol").alias("k")).agg(F.max("node_id").alias("src"))
    e = mentions.select(F.col("reaction_id").alias("dst"), F.upper("symbol").alias("k")).join(genes, "k").select("src", "dst").distinct()
    return e.join(g.edges.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("rel", F.lit("catalysis"))


def ppi_edges(pairs: DataFrame, genes: DataFrame, least: int = 400) -> DataFrame:
    """(src, dst, score) both ways from (a, b, score) symbols of 0..1000: both known, no loops, each unordered pair once at its best."""
    s = genes.groupBy(F.upper("symbol").alias("k")).agg(F.min("node_id").alias("id"))
    p = pairs.where(F.col("score") >= least).select(F.upper("a").alias("a"), F.upper("b").alias("b"), "score").where("a <> b")
    p = p.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg((F.max("score") / 1000).alias("score"))
    j = p.join(s.select(F.col("k").alias("a"), F.col("id").alias("src")), "a").join(s.select(F.col("k").alias("b"), F.col("id").alias("dst")), "b").where("src <> dst")
    return j.select("src", "dst", "score").unionByName(j.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "score"))
