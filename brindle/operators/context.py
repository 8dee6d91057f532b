"""A stored neighbourhood: what a question needs of the graph, sorted by name.

``build`` resolves both ends of every call once. A question then reads the rows of its hits' names from two tables that
are dealt and sorted by name, so that Parquet's statistics skip the rest; it joins neither edges nor nodes. Tables grow
with symbols and calls. A name of very many calls spans files, since rows are dealt by name and neighbour.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.graph import SYMBOLS, Graph

#: Hits up to which names are read by their values; more are joined.
MAX_NAMES = 1000
_EMPTY = "array<struct<name:string,direction:string,path:string>>"


def neighbours_by_name(graph: Graph) -> DataFrame:
    """(name, other, direction, path): the callers and callees of each name, sorted by both names."""
    symbols = graph.nodes.filter(F.col("label").isin(*SYMBOLS))
    ends = symbols.select("id", "name", "path")
    of = lambda side: ends.withColumnsRenamed({c: f"{side}_{c}" for c in ends.columns})
    calls = graph.edges.filter("type = 'CALLS'").select(F.col("src").alias("a_id"), F.col("dst").alias("b_id")).join(of("a"), "a_id").join(of("b"), "b_id")
    side = lambda name, other, path, direction: F.struct(F.col(name).alias("name"), F.col(other).alias("other"), F.lit(direction).alias("direction"), F.col(path).alias("path"))
    both = F.array(side("a_name", "b_name", "b_path", "callee"), side("b_name", "a_name", "a_path", "caller"))
    # dealt by name before they are counted, so that no task holds what it has read, and sorted once, for counting and for writing
    dealt = calls.select(F.inline(both)).repartitionByRange("name", "other")
    return dealt.groupBy("name", "other").agg(F.max(F.struct("direction", "path")).alias("best")).select("name", "other", "best.direction", "best.path").sortWithinPartitions("name", "other")


def build(graph: Graph, path: str) -> "Context":
    """Stores the neighbourhoods of ``graph`` below ``path``, which must not exist, and opens them."""
    symbols = graph.nodes.filter(F.col("label").isin(*SYMBOLS))
    neighbours_by_name(graph).write.parquet(f"{path}/near")
    first = symbols.groupBy("name").agg(F.min_by(F.struct("content", "path"), F.struct("path", "start_line")).alias("at")).select("name", F.col("at.content").alias("code"), "at.path")
    first.repartitionByRange("name").sortWithinPartitions("name").write.parquet(f"{path}/symbols")
    return Context(graph.nodes.sparkSession, path)


@dataclass(frozen=True)
class Context:
    """Stored neighbourhoods: ``symbols`` (name, code, path) and ``near`` (name, other, direction, path)."""

    spark: SparkSession
    path: str

    def _of(self, table: str, names: DataFrame | None, known: list[str] | None) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/{table}")
        return rows.join(names, "name", "left_semi") if known is None else rows.filter(F.col("name").isin(*known))

    def expand(self, names: DataFrame) -> DataFrame:
        """(name, code, path, neighbours) of ``names(name)``, as ``graph.expand`` gives them."""
        asked = names.select("name").filter("name is not null").distinct()
        few = asked.limit(MAX_NAMES + 1).collect()
        return self._expanded(asked, [r.name for r in few] if len(few) <= MAX_NAMES else None)

    def expand_known(self, names: list[str]) -> DataFrame:
        """``expand`` of a few names that are at hand."""
        return self._expanded(None, names)

    def _expanded(self, asked: DataFrame | None, known: list[str] | None) -> DataFrame:
        listed = F.sort_array(F.collect_list(F.struct(F.col("other").alias("name"), "direction", "path")))
        near = self._of("near", asked, known).groupBy("name").agg(listed.alias("neighbours"))
        return self._of("symbols", asked, known).join(near, "name", "left").select("name", "code", "path", F.coalesce("neighbours", F.array().cast(_EMPTY)).alias("neighbours"))
