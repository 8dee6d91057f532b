"""Maintenance of the graph by deltas: what a batch of changed files adds to and takes from nodes and edges.

Calls link names, so that a definition in one file can make edges between others. Kept beside the graph are the definitions by name and
the calls by caller and by callee, one row for each file that says so: a pair of names stands as long as one file supports it. Of a batch only
differences enter: definitions that came or went, and pairs whose support rose from or fell to nothing. Two joins each give the edges:

* pairs that came or went, with the definitions of both names;
* definitions that came or went, with the pairs of their name on either side and the definitions of the other name.

Tables of names are dealt to parts by their first column, nodes by id and edges by both ends, so that a node of many edges lies in many parts. A batch reads the parts of the names that it touches and of those that these call or are called by,
and rewrites the parts whose rows change; files of other names are not read. Everything that a batch changes is committed at once by the store, with whatever
else the caller commits. The result is that of ``graph.build`` over all files, by path and by name (``identity="path"``, ``resolve="name"``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import graph as G
from brindle.session import shared_path
from brindle.sources.sinks import Store

PARTS = 64
NAMES = {
    "functions": "name string, id string, path string", "by_caller": "caller string, callee string, path string", "by_callee": "callee string, caller string, path string",
    "classes": "name string, id string, path string", "bases": "base string, id string, path string", "imports": "module string, path string",
}
EDGE, LOCAL = ["src", "dst", "type"], ("CONTAINS", "DEFINES", "IMPORTS")
Parts = dict[str, tuple[DataFrame, str, list[str]]]


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def part(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in columns]), F.lit(PARTS)).cast("string")


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with their part, dealt so that a part is one file, or several where it is large."""
    return rows.withColumn("part", part(*columns)).hint("rebalance", "part")


def said(extracted: DataFrame) -> dict[str, DataFrame]:
    """What files say, as the tables of ``NAMES``."""
    functions = extracted.select("path", F.inline("functions")).filter("class_name is null and not is_nested").withColumn("id", G.symbol_id("Function", "path"))
    classes = extracted.select("path", F.inline("classes")).withColumn("id", G.symbol_id("Class", "path"))
    calls = functions.select(F.col("name").alias("caller"), F.explode("calls.name").alias("callee"), "path").distinct()
    return {
        "functions": functions.select("name", "id", "path").distinct(), "by_caller": calls, "by_callee": calls.select("callee", "caller", "path"), "classes": classes.select("name", "id", "path").distinct(),
        "bases": classes.select(F.explode("bases").alias("base"), "id", "path").distinct(), "imports": extracted.select("path", F.inline("imports")).filter("module is not null").select("module", "path").distinct(),
    }


class Names:
    """The tables of ``NAMES`` in a store, as they are before and after files ``paths(path)`` came to say ``new`` instead of ``old``."""

    def __init__(self, store: Store, paths: DataFrame, old: dict[str, DataFrame], new: dict[str, DataFrame]):
        self.store, self.paths, self.old, self.new = store, paths, old, new

    def before(self, table: str, names: DataFrame) -> DataFrame:
        """Rows of the parts that hold ``names``, and of these names alone."""
        key = NAMES[table].split()[0]
        kept = f"names_{table}"
        if not self.store.exists(kept):
            return self.old[table].limit(0)
        own = names.toDF(key).distinct()
        parts = [r[0] for r in own.select(part(key)).distinct().collect()]  # at most PARTS
        return self.store.read(kept, parts).join(own, key, "left_semi")

    def after(self, table: str, names: DataFrame) -> DataFrame:
        key = NAMES[table].split()[0]
        own = self.new[table].join(names.toDF(key).distinct(), key, "left_semi")
        return self.before(table, names).join(self.paths, "path", "left_anti").unionByName(own)

    def rewritten(self) -> Parts:
        """The parts whose rows change."""
        out: Parts = {}
        for table in NAMES:
            key, kept = NAMES[table].split()[0], f"names_{table}"
            changed = [r[0] for r in self.old[table].select(key).union(self.new[table].select(key)).select(part(key)).distinct().collect()]  # at most PARTS
            there = self.store.read(kept, changed).join(self.paths, "path", "left_anti") if self.store.exists(kept) else self.new[table].limit(0)
            out[kept] = (_dealt(there.unionByName(self.new[table]), key), "part", changed)
        return out


def call_edges(pairs: DataFrame, callers: DataFrame, callees: DataFrame) -> DataFrame:
    """CALLS of pairs (caller, callee) between definitions (name, id)."""
    found = pairs.select("caller", "callee").distinct().join(callers.select(F.col("name").alias("caller"), F.col("id").alias("src")), "caller").join(callees.select(F.col("name").alias("callee"), F.col("id").alias("dst")), "callee")
    return found.select("src", "dst", F.lit("CALLS").alias("type"))


def _calls(of, definitions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges of ``definitions`` that came (or went) and of ``pairs`` that did, where ``of`` looks names up as they are after (or before)."""
    names = definitions.select("name")
    out = _stored(of("by_caller", names).select("caller", "callee").distinct(), "pairs-out")
    into = _stored(of("by_callee", names).select("caller", "callee").distinct(), "pairs-in")
    first = call_edges(out, definitions, of("functions", out.select("callee")))
    second = call_edges(into, of("functions", into.select("caller")), definitions)
    third = call_edges(pairs, of("functions", pairs.select("caller")), of("functions", pairs.select("callee")))
    return _union(first, second, third).distinct()


def _bases(of, classes: DataFrame, bases: DataFrame) -> DataFrame:
    """INHERITS of classes and of bases that came (or went)."""
    edge = lambda b, c: b.select("base", F.col("id").alias("src")).join(c.select(F.col("name").alias("base"), F.col("id").alias("dst")), "base").select("src", "dst", F.lit("INHERITS").alias("type"))
    return edge(bases, of("classes", bases.select("base"))).unionByName(edge(of("bases", classes.select("name")), classes)).distinct()


def changes(store: Store, before: DataFrame, after: DataFrame, paths: DataFrame, repository: str = "repository") -> Parts:
    """What to commit when the files ``paths(path)``, extracted as ``before``, are extracted as ``after``: parts of the names, of ``graph_nodes`` and of ``graph_edges``."""
    if not store.exists("graph_edges"):  # nothing is kept yet: all is new
        first, whole = said(after), G.build(after, repository)
        dealt = lambda df, *on: (_dealt(df, *on), "part", [])
        return {f"names_{t}": dealt(df, NAMES[t].split()[0]) for t, df in first.items()} | {"graph_edges": dealt(whole.edges.select(*EDGE), *EDGE), "graph_nodes": dealt(whole.nodes, "id")}
    paths = paths.select("path").distinct()
    old, new = ({t: _stored(df, f"said-{t}") for t, df in said(rows).items()} for rows in (before, after))
    names = Names(store, paths, old, new)
    minus = lambda a, b, t: _stored(a[t].join(b[t], list(a[t].columns), "left_anti"), f"delta-{t}")
    came = {t: minus(new, old, t) for t in ("functions", "by_caller", "classes", "bases")}
    went = {t: minus(old, new, t) for t in ("functions", "by_caller", "classes", "bases", "imports")}
    asked = came["by_caller"].unionByName(went["by_caller"]).select("caller", "callee").distinct()
    support = lambda of, name: of("by_caller", asked.select("caller")).join(asked, ["caller", "callee"], "left_semi").groupBy("caller", "callee").agg(F.count(F.lit(1)).alias(name))
    counted = _stored(support(names.before, "was").join(support(names.after, "now"), ["caller", "callee"], "full_outer"), "support")
    added = _calls(names.after, came["functions"], counted.filter("was is null")).unionByName(_bases(names.after, came["classes"], came["bases"]))
    gone = _calls(names.before, went["functions"], counted.filter("now is null")).unionByName(_bases(names.before, went["classes"], went["bases"]))
    now, then = G.build(after, repository), G.build(before, repository)
    local = lambda g: g.edges.filter(F.col("type").isin(*LOCAL)).select(*EDGE)
    own, had = _stored(local(now), "edges-own"), _stored(local(then), "edges-had")
    lines = _stored(added.unionByName(own.join(had, EDGE, "left_anti")), "edges-came")
    lost = _stored(gone.unionByName(had.join(own, EDGE, "left_anti")), "edges-gone")
    modules = went["imports"].select("module").distinct()
    unsaid = modules.join(names.after("imports", modules).select("module"), "module", "left_anti").select(G.node_id("Module", F.col("module")).alias("id"))
    nodes = _stored(now.nodes, "nodes-came")
    dead = then.nodes.filter(~F.col("label").isin("Repository", "Module")).select("id").unionByName(unsaid)
    dead = _stored(dead.unionByName(nodes.select("id")).distinct(), "nodes-gone")  # those that come replace themselves
    return names.rewritten() | {"graph_edges": _replaced(store, "graph_edges", lost, lines, EDGE), "graph_nodes": _replaced(store, "graph_nodes", dead, nodes, ["id"])}


def _replaced(store: Store, name: str, gone: DataFrame, come: DataFrame, on: list[str]) -> tuple[DataFrame, str, list[str]]:
    """The parts of a table in which rows go or come, without the first and with the second."""
    touched = [r[0] for r in gone.select(*on).union(come.select(*on)).select(part(*on)).distinct().collect()]  # at most PARTS
    rows = come if not store.exists(name) else store.read(name, touched).join(gone.select(*on).distinct(), on, "left_anti").unionByName(come)
    return _dealt(rows, *on), "part", touched


def graph(store: Store) -> G.Graph:
    """The graph as the store keeps it."""
    edges = store.read("graph_edges").withColumns({"count": F.lit(None).cast("long"), "updated_at": F.lit(None).cast("timestamp")})
    return G.Graph(store.read("graph_nodes"), edges)
