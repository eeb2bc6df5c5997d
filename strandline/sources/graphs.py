"""Graph files: node-link JSON, GraphML, OBO, XML products; Parquet bundles."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph


def read_node_link(spark: SparkSession, path: str) -> Graph:
    """A node-link document: nodes by id, edges from "edges" or "links"; of repeated pairs the last counts; relation is role or else edge_type."""
    d = spark.read.option("multiLine", True).json(path)
    key = "edges" if "edges" in d.columns else "links"
    n = d.select(F.explode("nodes").alias("n")).select("n.*").withColumnRenamed("id", "node_id")
    n = n.withColumn("node_id", F.col("node_id").cast("string"))
    e = d.select(F.posexplode(key).alias("seq", "e")).select("seq", "e.*")
    e = e.withColumnsRenamed({"source": "src", "target": "dst"})
    e = e.withColumns({c: F.col(c).cast("string") for c in ("src", "dst")})
    have = [F.col(c) for c in ("role", "edge_type") if c in e.columns]
    e = e.withColumn("rel", F.lower(F.coalesce(*have, F.lit(""))))
    w = Window.partitionBy("src", "dst").orderBy(F.desc("seq"))
    e = e.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "seq")
    return Graph(n, e.select("src", "dst", "rel", *(c for c in e.columns if c not in ("src", "dst", "rel"))))


def write_node_link(g: Graph, path: str) -> None:
    """The document in one file: rows stream through the driver a partition at a time."""
    with open(path, "w") as f:
        f.write('{"directed": true, "multigraph": false, "graph": {}, "nodes": [')
        for part, rows in (("nodes", g.nodes.withColumnRenamed("node_id", "id")), ("links", g.edges.withColumnsRenamed({"src": "source", "dst": "target"}))):
            if part == "links":
                f.write('], "links": [')
            for i, r in enumerate(rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).toLocalIterator()):
                f.write((", " if i else "") + r["j"])
        f.write("]}")


def flat(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Every column as text: arrays joined by |, maps and structs as JSON, null as empty."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("array<string"):
            c = F.array_join(c, "|")
        elif kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        out.append((c if name in keep else F.coalesce(c.cast("string"), F.lit(""))).alias(name))
    return df.select(*out)


def write_graphml(g: Graph, path: str) -> None:
    n, e = flat(g.nodes, ("node_id",)), flat(g.edges, ("src", "dst"))
    fields = [("n", c) for c in n.columns if c != "node_id"] + [("e", c) for c in e.columns if c not in ("src", "dst")]
    ids = {k: f"d{i}" for i, k in enumerate(fields)}
    with open(path, "w") as f:
        f.write('<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        for (part, c), i in ids.items():
            f.write(f'<key id="{i}" for="{"node" if part == "n" else "edge"}" attr.name={quoteattr(c)} attr.type="string"/>\n')
        f.write('<graph edgedefault="directed">\n')
        data = lambda part, r: "".join(f'<data key="{ids[part, c]}">{escape(r[c])}</data>' for p, c in fields if p == part)
        for r in n.toLocalIterator():
            f.write(f"<node id={quoteattr(r['node_id'])}>{data('n', r)}</node>\n")
        for r in e.toLocalIterator():
            f.write(f"<edge source={quoteattr(r['src'])} target={quoteattr(r['dst'])}>{data('e', r)}</edge>\n")
        f.write("</graph>\n</graphml>\n")


def read_graphml(spark: SparkSession, path: str, lists: tuple[str, ...] = ("ec_numbers", "pathways")) -> Graph:
    """Nodes and edges of a GraphML file; the ``lists`` are split at |."""
    xml = lambda tag: spark.read.format("xml").option("rowTag", tag).option("valueTag", "value")
    keys = {r["i"]: (r["f"], r["n"]) for r in xml("key").schema("_id string, _for string, `_attr.name` string").load(path).select(F.col("_id").alias("i"), F.col("_for").alias("f"), F.col("`_attr.name`").alias("n")).collect()}
    data = "data array<struct<_key:string,value:string>>"

    def value(key: str):
        held = F.filter("data", lambda d: d["_key"] == key)
        return F.nullif(F.get(F.transform(held, lambda d: d["value"]), F.lit(0)), F.lit(""))

    def columns(part: str):
        for i, (f, name) in keys.items():
            if f == part:
                yield (F.split(value(i), r"\|") if name in lists else value(i)).alias(name)

    n = xml("node").schema(f"_id string, {data}").load(path).select(F.col("_id").alias("node_id"), *columns("node"))
    e = xml("edge").schema(f"_source string, _target string, {data}").load(path).select(F.col("_source").alias("src"), F.col("_target").alias("dst"), *columns("edge"))
    return Graph(n, e)


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """(term_id, name, definition, obsolete, parents, xrefs, synonyms) of an ontology's [Term] stanzas: the file is split at stanzas, each parsed by itself."""
    t = spark.read.option("lineSep", "\n[").text(path).where("startswith(value, 'Term]')")
    field = lambda tag: F.regexp_extract_all("value", F.lit(rf"(?m)^{tag}: (.*)$"), F.lit(1))
    return t.select(
        F.get(field("id"), F.lit(0)).alias("term_id"),
        F.get(field("name"), F.lit(0)).alias("name"),
        F.nullif(F.regexp_extract("value", r'(?m)^def: "((?:[^"\\]|\\.)*)"', 1), F.lit("")).alias("definition"),
        F.array_contains(field("is_obsolete"), "true").alias("obsolete"),
        F.transform(field("is_a"), lambda x: F.substring_index(F.trim(F.substring_index(x, "!", 1)), " ", 1)).alias("parents"),
        F.transform(field("xref"), lambda x: F.substring_index(F.trim(x), " ", 1)).alias("xrefs"),
        F.transform(field("synonym"), lambda x: F.regexp_extract(x, r'^"((?:[^"\\]|\\.)*)"', 1)).alias("synonyms"),
    ).where("term_id IS NOT NULL")


def descendants(terms: DataFrame, roots: list[str], depth: int | None = None) -> DataFrame:
    """term_id of roots and all under them (``depth`` levels at most, if given)."""
    from ..operators.iterate import reach

    pairs = terms.select(F.col("term_id").alias("other"), F.explode("parents").alias("node_id"))
    starts = terms.sparkSession.createDataFrame([(r,) for r in roots], "start string")
    return reach(pairs, starts, depth).select(F.col("node_id").alias("term_id")).distinct()


def xref_buckets(terms: DataFrame) -> DataFrame:
    """(term_id, prefix, ids): cross references by the prefix before the colon."""
    x = terms.select("term_id", F.explode("xrefs").alias("x")).where("contains(x, ':')")
    return x.groupBy("term_id", F.upper(F.substring_index("x", ":", 1)).alias("prefix")).agg(F.array_sort(F.collect_set(F.substring_index("x", ":", -1))).alias("ids"))


def read_disorders(spark: SparkSession, path: str) -> DataFrame:
    """(orpha_id, name, omim, genes) from an XML product of <Disorder> rows."""
    schema = """OrphaCode string, Name struct<_VALUE:string>, ExternalReferenceList struct<ExternalReference:array<struct<Source:string,Reference:string>>>,
      DisorderGeneAssociationList struct<DisorderGeneAssociation:array<struct<Gene:struct<Symbol:string>>>>"""
    d = spark.read.format("xml").option("rowTag", "Disorder").schema(schema).load(path)
    refs, genes = F.col("ExternalReferenceList.ExternalReference"), F.col("DisorderGeneAssociationList.DisorderGeneAssociation")
    none = F.array().cast("array<string>")
    return d.select(
        F.concat(F.lit("ORPHA:"), "OrphaCode").alias("orpha_id"),
        F.col("Name._VALUE").alias("name"),
        F.coalesce(F.transform(F.filter(refs, lambda r: r["Source"] == "OMIM"), lambda r: r["Reference"]), none).alias("omim"),
        F.coalesce(F.array_distinct(F.transform(genes, lambda g: g["Gene"]["Symbol"])), none).alias("genes"),
    )


def reactome_reactions(spark: SparkSession, path: str) -> Graph:
    """Reactions, metabolites and edges from cached detail documents, a JSON object a line: stId, displayName, input, output (schemaClass, stId, identifier, compartment)."""
    entry = "array<struct<schemaClass:string,stId:string,displayName:string,identifier:string,compartment:string>>"
    d = spark.read.schema(f"stId string, displayName string, pathways array<string>, input {entry}, output {entry}").json(path)
    part = lambda c, rel: d.select("stId", F.explode(c).alias("x"), F.lit(rel).alias("rel")).where(F.col("x.schemaClass").isin("SimpleEntity", "ChemicalDrug", "OtherEntity"))
    p = part("input", "substrate").unionByName(part("output", "product"))
    own = F.when(F.col("x.identifier").isNotNull(), F.concat_ws("@", F.concat(F.lit("CHEBI:"), "x.identifier"), "x.compartment")).otherwise(F.concat(F.lit("reactome:"), "x.stId"))
    p = p.select("stId", own.alias("met"), F.col("x.displayName").alias("name"), F.col("x.compartment").alias("compartment"), "rel")
    rxn = F.concat(F.lit("reactome:"), "stId")
    nodes = d.select(rxn.alias("node_id"), F.lit("reaction").alias("node_type"), F.col("displayName").alias("name"), F.array_sort("pathways").alias("pathways"))
    mets = p.groupBy(F.col("met").alias("node_id")).agg(F.lit("metabolite").alias("node_type"), F.min("name").alias("name"), F.min("compartment").alias("compartment"))
    side = F.col("rel") == "substrate"
    e = p.select(F.when(side, F.col("met")).otherwise(rxn).alias("src"), F.when(side, rxn).otherwise(F.col("met")).alias("dst"), "rel").distinct()
    return Graph(nodes.unionByName(mets, allowMissingColumns=True), e)


def save_bundle(g: Graph, path: str, about: dict | None = None) -> dict:
    """Parquet tables (nodes by type, edges by relation) and a manifest of counts and settings, written last."""
    g.nodes.write.mode("overwrite").partitionBy("node_type").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")
    spark = g.nodes.sparkSession
    b = load_bundle(spark, path)
    m = {"node_counts": {r[0]: r[1] for r in b.nodes.groupBy("node_type").count().collect()}, "edge_counts": {r[0]: r[1] for r in b.edges.groupBy("rel").count().collect()}, **(about or {})}
    spark.createDataFrame([(json.dumps(m, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return m


def load_bundle(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])
