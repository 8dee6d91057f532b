"""Retrieval as one plan: keyword and vector hits, merged by name, with the neighbourhood of each symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import text
from brindle.operators import graph as G
from brindle.operators import search
from brindle.operators.context import MAX_NAMES, Context


def symbol_documents(graph: G.Graph) -> DataFrame:
    """(id, name, text) of each function and class, distinct: what the keyword index holds."""
    symbols = graph.nodes.filter(F.col("label").isin(*G.SYMBOLS))
    return symbols.select("id", "name", text.keyword_text(F.col("name"), F.lit(None).cast("string"), F.col("content")).alias("text")).distinct()


def symbol_vectors(graph: G.Graph, size: int = 64) -> DataFrame:
    """(id, name, type, start_line, embedding) by hashed words, where no embeddings of a model are given."""
    symbols = graph.nodes.filter(F.col("label").isin(*G.SYMBOLS))
    said = text.symbol_text(F.col("label"), F.col("name"), F.col("signature"))
    return symbols.select("id", "name", F.col("label").alias("type"), "start_line", text.tokens(F.concat_ws(" ", F.regexp_replace(said, "_", " "), "content")).alias("w")).select("id", "name", "type", "start_line", _hashed(size).alias("embedding"))


def _hashed(size: int):
    from brindle.functions.vectors import hashed_embedding

    return hashed_embedding(F.col("w"), size)


def build_index(graph: G.Graph, path: str) -> search.Index:
    """The stored keyword index over the graph's symbols: built once, asked often."""
    return search.build_index(symbol_documents(graph), path, "id")


def with_context(graph: G.Graph | Context, hits: DataFrame) -> DataFrame:
    """(name, score, code, path, neighbours) of hits (name, score), best first; from a stored neighbourhood if ``graph`` is one."""
    ordered = lambda hits, expanded: hits.join(expanded, "name").orderBy(F.desc("score"), "name")
    if not isinstance(graph, Context):
        return ordered(hits, G.expand(graph, hits.select("name")))
    few = hits.limit(MAX_NAMES + 1).collect()
    if len(few) > MAX_NAMES:
        return ordered(hits, graph.expand(hits))
    # found once, not once for their names and once for their scores; as many rows as hits are a top-k and no sort by range
    known = [r.name for r in few if r.name is not None]
    return ordered(search.local(hits.sparkSession, few, hits.schema), graph.expand_known(known)).limit(MAX_NAMES)


def retrieve_context(graph: G.Graph, query: str, k: int = 10, vectors: DataFrame | None = None, query_vector: list[float] | None = None, index: search.Index | None = None) -> DataFrame:
    """(name, score, code, path, neighbours): the ``k`` best symbols for a question, best first; by a stored ``index`` if there is one."""
    docs = symbol_documents(graph)
    if index is not None:
        keyword = index.top(query, k).withColumnRenamed("key", "id").join(docs.select("id", "name"), "id").select("name", "score")
    else:
        keyword = search.top(search.bm25(docs, query, "id").join(docs.select("id", "name"), "id").select("name", "score"), k, "name")
    vectors = symbol_vectors(graph) if vectors is None else vectors
    if query_vector is None:
        query_vector = graph.nodes.sparkSession.range(1).select(text.tokens(F.lit(query)).alias("w")).select(_hashed(64).alias("v")).first()["v"]
    near = search.vector_search(vectors, query_vector, k, "id").join(vectors.select("id", "name"), "id").select("name", "score")
    return with_context(graph, search.hybrid_search(near, keyword, k))
