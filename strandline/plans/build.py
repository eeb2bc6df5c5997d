"""A graph build as named steps, each from graph to graph, with a record of what ran.

Steps are lazy plans; after each the tables are cut (checkpoint), so a failing step
is known by name, leaves the graph as it was, and the build goes on.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from ..graph import Graph
from ..operators.iterate import cut
from ..sources.graphs import load_bundle, read_manifest, save_bundle

Step = Callable[[Graph], Graph]


@dataclass
class Build:
    graph: Graph
    steps: list[tuple[str, Step]] = field(default_factory=list)
    log: list[dict] = field(default_factory=list)

    def add(self, name: str, step: Step) -> Build:
        self.steps.append((name, step))
        return self

    def add_nodes(self, name: str, nodes) -> Build:
        return self.add(name, lambda g: g.upsert_nodes(nodes))

    def add_edges(self, name: str, edges) -> Build:
        """Edges whose ends are both known; a warehouse of others is no part of a graph."""
        return self.add(name, lambda g: g.upsert_edges(Graph(g.nodes, edges).induced(g.nodes).edges))

    def add_pathways(self) -> Build:
        return self.add("pathways", Graph.promote_pathways)

    def add_currency(self, ids) -> Build:
        return self.add("currency", lambda g: g.flag_currency(ids(g)))

    def run(self) -> Graph:
        g = self.graph
        for name, step in self.steps:
            began, row = time.time(), {"step": name, "ok": True, "error": None}
            try:
                new = step(g)
                g = Graph(cut(new.nodes), cut(new.edges))
            except Exception as e:  # noqa: BLE001  a failing step is recorded and the build goes on
                row.update(ok=False, error=str(e)[:500])
            row["seconds"] = time.time() - began
            self.log.append(row)
        return g

    def save(self, g: Graph, path: str) -> dict:
        return save_bundle(g, path, {"steps": self.log})


def verify(spark, path: str, expected: list[str]) -> dict:
    """Counts of the manifest against the tables, and expected steps that are missing or failed."""
    m, g = read_manifest(spark, path), load_bundle(spark, path)
    now = {r[0]: r[1] for r in g.nodes.groupBy("node_type").count().collect()}
    ran = {s["step"] for s in m["steps"] if s["ok"]}
    return {"counts_match": now == m["node_counts"], "missing_steps": sorted(set(expected) - ran)}
