"""Dynamic analysis as one plan over one trace: pairs, edges, types, enrichment, with the result of each stage."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import graph as G
from brindle.operators import trace as T


@dataclass
class DynamicAnalysis:
    stages: list[tuple[int, str, bool, float]] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    error: str | None = None
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Lets go of the cached trace and tables, when what was made of them is written."""
        for df in self.cached:
            df.unpersist()


def analyze(graph: G.Graph, events: DataFrame, run: str = "run") -> DynamicAnalysis:
    """Runs the stages in order over one cached trace and stops at the first that fails."""
    out = DynamicAnalysis()
    functions = graph.nodes.filter("label = 'Function'")
    events = events.cache()
    out.cached.append(events)
    calls = events.filter("event = 'call' and arg_types is not null").select("func", "arg_types")
    steps = {
        "profile": lambda: T.summary(events),
        "call_pairs": lambda: T.without_markers(T.call_pairs(events, run)),
        "call_edges": lambda: T.dynamic_edges(out.tables["call_pairs"], functions),
        "types": lambda: T.argument_types(calls),
        "enrichment": lambda: T.enrich_functions(functions.select("id", "name"), calls),
    }
    for position, (name, step) in enumerate(steps.items()):
        began = time.monotonic()
        try:
            table = step().cache()
            out.cached.append(table)
            table.count()
        except Exception as e:
            out.stages.append((position, name, False, time.monotonic() - began))
            out.error = f"{name}: {e}"
            break
        out.tables[name] = table
        out.stages.append((position, name, True, time.monotonic() - began))
    return out


def enriched_graph(graph: G.Graph, analysis: DynamicAnalysis, coverage_edges: DataFrame | None = None, tests: DataFrame | None = None) -> G.Graph:
    """The graph with runtime call edges added up, and coverage edges and test nodes if given."""
    counted = T.dynamic_edges(analysis.tables["call_pairs"], graph.nodes.filter("label = 'Function'"))
    static = graph.edges.filter("type <> 'DYNAMICALLY_CALLS'")
    dynamic = G.accumulate(graph.edges.filter("type = 'DYNAMICALLY_CALLS'"), counted).drop("state")
    edges = static.unionByName(dynamic, allowMissingColumns=True)
    nodes = graph.nodes
    if coverage_edges is not None:
        edges = edges.unionByName(coverage_edges.distinct(), allowMissingColumns=True)
    if tests is not None:
        nodes = nodes.unionByName(tests.join(nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)
    return G.Graph(nodes, edges.withColumn("updated_at", F.coalesce("updated_at", F.current_timestamp())))
