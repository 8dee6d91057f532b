"""Pattern drift as one plan: similar symbols by vectors, with their code and that of their neighbours, and siblings, against changed symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import graph as G
from brindle.operators import patterns
from brindle.operators.vector_index import VectorIndex

#: Hits of a changed symbol, and what a neighbour of a hit is worth of the hit's score.
HITS, NEIGHBOUR = 6, 0.8


def similar(changed: DataFrame, index: VectorIndex, symbols: DataFrame, edges: DataFrame | None = None, hits: int = HITS, share: float = NEIGHBOUR, **how) -> DataFrame:
    """(path, symbol, name, content, score): candidates of changed symbols (key, path, name, embedding).

    The nearest of the indexed ``symbols(key, name, content)``, and with ``edges(src, dst, type)`` between their ids (``id`` of symbols) the
    callers and callees of these, at a share of their score. Changed symbols are told apart by key, a whole number that is that of an indexed
    symbol only where both are the same.
    """
    near = index.nearest(changed, hits, "key", "embedding", **how).select("query", F.col("key").alias("hit"), "score")
    known = symbols.select(F.col("key").alias("hit"), *(["id"] if edges is not None else []), F.col("name").alias("other"), "content")
    found = near.join(known, "hit")
    rows = found.select("query", "other", "content", "score")
    if edges is not None:
        beside = G.neighbours(edges, found.select("id").distinct()).join(found.select("id", "query", "score"), "id")
        beside = beside.join(symbols.select(F.col("id").alias("neighbour"), F.col("name").alias("other"), "content"), "neighbour")
        rows = rows.unionByName(beside.select("query", "other", "content", (F.col("score") * share).alias("score")))
    named = changed.select(F.col("key").alias("query"), "path", F.col("name").alias("symbol"))
    return rows.join(named, "query").select("path", "symbol", F.col("other").alias("name"), "content", "score")


def findings(changed: DataFrame, index: VectorIndex, symbols: DataFrame, edges: DataFrame | None = None, siblings: DataFrame | None = None, **how) -> DataFrame:
    """Findings of changed symbols (key, path, name, content, embedding) against ``similar`` ones and their ``siblings(path, name, content)``."""
    none = changed.select("path", "name", "content").limit(0) if siblings is None else siblings
    return patterns.detect(changed.select("path", "name", "content"), none, similar(changed, index, symbols, edges, **how))
