"""Command line: build, qc, score. Graphs are Parquet bundles or node-link JSON."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import qc, scoring
from .sources import graphs, tables


def _graph(spark: SparkSession, path: str):
    return graphs.read_node_link(spark, path) if path.endswith(".json") else graphs.load_bundle(spark, path)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="strandline")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="read a graph, promote pathways, write a bundle")
    b.add_argument("graph")
    b.add_argument("out")
    q = sub.add_parser("qc", help="readiness figures")
    q.add_argument("graph")
    q.add_argument("--components", action="store_true")
    s = sub.add_parser("score", help="score reactions from an evidence table")
    s.add_argument("graph")
    s.add_argument("evidence", help="CSV with feature and effect columns; features are node ids")
    s.add_argument("--out", help="Parquet folder; the best twenty are shown otherwise")
    s.add_argument("--gate", action="store_true", help="scale by the enzymes' gate")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("strandline").getOrCreate()
    g = _graph(spark, a.graph)
    if a.command == "build":
        print(graphs.save_bundle(g.promote_pathways() if "pathways" in g.nodes.columns else g, a.out))
    elif a.command == "qc":
        qc.readiness(g, a.components).show(100, False)
    else:
        e = tables.evidence(tables.read_delimited(spark, a.evidence)).withColumnRenamed("feature_id", "node_id")
        e = scoring.evidence_table(e)
        r = scoring.score_reactions(g, e)
        if a.gate:
            r = scoring.apply_gate(r, scoring.enzyme_gate(g, e))
        if a.out:
            r.write.mode("overwrite").parquet(a.out)
        else:
            from pyspark.sql import functions as F

            r.orderBy(F.desc(F.abs("score")), "reaction_id").show(20, False)


if __name__ == "__main__":
    main()
