"""Retrieval: BM25 over an inverted index, exact nearest vectors, and their hybrid.

``build_index`` stores an index once; ``Index`` answers questions from it. A question reads the postings of its own words
alone: they are sorted by term, so that Parquet's statistics skip the rest, and a frequent term spans many files. Texts
are read by ``build_index`` and by nothing else. ``bm25`` answers one question without an index, in two passes over texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brindle.functions.text import STOP_WORDS, TOKEN_BREAK, tokens
from brindle.functions.vectors import cosine

K1, B, EPSILON = 1.5, 0.75, 0.25
WEIGHTS = (0.6, 0.4)
#: Rows of a block of vectors, which is compared with a block of queries at once.
BLOCK = 4096
#: Postings of one term that leave a task as one row, and postings that a task puts together at once.
RUN, CHUNK = 32, 3_000_000
#: Bytes of texts whose words a task counts at once.
PIECE = 1_000_000
#: What stands between words beyond ASCII, and each byte with a blank for what stands there in ASCII.
BREAK_BEYOND = TOKEN_BREAK.replace("[^", r"[^\x00-\x7f", 1)
BLANKED = bytes(b if b > 127 or chr(b).isalnum() or chr(b) == "_" else 32 for b in range(256))


def repeats(rows: DataFrame, key: str) -> bool:
    """Whether rows share a key, or several lack one. Keys alone are read and shuffled."""
    return not rows.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("n").limit(1).isEmpty()


def _ranked(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words as places in the sorted list of those that differ, and that list."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(order)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, dl, terms, tfs) of (key, text), where text is in lower case and what is no word in it is ASCII: words are cut, named by numbers and counted for ``PIECE`` bytes of texts at once."""
    left_out = pa.array(["", *STOP_WORDS])

    def count(keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        n, ends = len(texts), np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        plain = bytes(memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]]).translate(BLANKED)
        cut = pc.split_pattern(pa.StringArray.from_buffers(n, pa.py_buffer(ends - ends[0]), pa.py_buffer(plain)), " ")
        said, known = _ranked(cut.flatten())
        kept = ~pc.is_in(known, value_set=left_out).to_numpy(zero_copy_only=False)
        both = (np.repeat(np.arange(n) * len(known), np.diff(cut.offsets.to_numpy())) + said)[kept[said]]
        both.sort()
        starts = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
        tf = np.diff(np.append(starts, len(both)))
        row, word = np.divmod(both[starts], max(len(known), 1))
        offsets = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
        dl = pa.array(np.bincount(row, tf, n).astype(np.int64))
        terms = pc.binary_join(pa.ListArray.from_arrays(offsets, known.take(pa.array(word))), " ")
        return pa.RecordBatch.from_arrays([keys, dl, terms, pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))], names=["key", "dl", "terms", "tfs"])

    for batch in batches:
        keys, texts, at = batch.column("key"), batch.column("text"), 0
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PIECE, "right")))
            yield count(keys.slice(at, to - at), texts.slice(at, to - at))
            at = to


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dl, terms, tfs): a row for each row of ``docs``, with its length in words, its different words, sorted and joined by blanks, and how often it says each.

    Words are those of ``tokens``. They are counted within a batch of rows, so that nothing is shuffled, and no table of counts is held.
    """
    lower = docs.select(F.col(key).alias("key"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    # what is no word beyond ASCII is found as ``tokens`` finds it, in texts that go beyond it; the rest is a look-up of bytes
    rows = lower.select("key", F.when(F.octet_length("text") == F.length("text"), F.col("text")).otherwise(F.regexp_replace("text", BREAK_BEYOND, " ")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(_counts, f"key {kind}, dl bigint, terms string, tfs array<int>")


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, dl, term, tf): how often each document says each term, beside its length in words; one row with a null term for a document without words.

    Only where rows share a key are counts shuffled, to become one row for each key, length and term.
    """
    of = counted(docs, key, text).select("key", "dl", F.explode_outer(F.when(F.col("dl") > 0, F.arrays_zip(F.split("terms", " ").alias("term"), F.col("tfs").alias("tf")))).alias("p"))
    rows = of.select("key", "dl", "p.term", F.coalesce(F.col("p.tf"), F.lit(1)).cast("long").alias("tf"))
    return rows.groupBy("key", "dl", "term").agg(F.sum("tf").alias("tf")) if repeats(docs, key) else rows


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, keys, counts): the postings of (key, dl, terms, tfs), at most ``RUN`` of one term in a row, those of ``CHUNK`` postings sorted by term; a count is dl and tf as one number."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        words = pc.split_pattern(rows.column("terms").combine_chunks(), " ")
        doc = np.repeat(np.arange(rows.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        codes, known = _ranked(words.flatten())
        order = codes << 32 | np.arange(len(codes))  # sorted as one number: faster than an order that is stable
        order.sort()
        codes, order = order >> 32, order & 0xFFFFFFFF
        doc, place = doc[order], np.arange(len(order))
        begins = np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]
        starts = np.flatnonzero((place - np.maximum.accumulate(np.where(begins, place, 0))) % RUN == 0)
        counts = (rows.column("dl").to_numpy()[doc] << 32) | rows.column("tfs").combine_chunks().flatten().to_numpy()[order]
        offsets, keys = pa.array(np.append(starts, len(order)), pa.int32()), rows.column("key").combine_chunks().take(pa.array(doc))
        return pa.RecordBatch.from_arrays([known.take(pa.array(codes[starts])), pa.ListArray.from_arrays(offsets, keys), pa.ListArray.from_arrays(offsets, pa.array(counts))], names=["term", "keys", "counts"])

    held, size = [], 0
    for batch in batches:
        ends, at = np.cumsum(pc.list_value_length(batch.column("tfs")).to_numpy(zero_copy_only=False)), 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + CHUNK - size, "right")))
            held.append(batch.slice(at, to - at))
            size, at = size + ends[to - 1] - done, to
            if at < batch.num_rows or size >= CHUNK:
                yield block(pa.Table.from_batches(held))
                held, size = [], 0
    if held:
        yield block(pa.Table.from_batches(held))


def _made(counts: DataFrame) -> DataFrame:
    kind = counts.schema["key"].dataType.simpleString()
    return counts.filter("dl > 0").select("key", "dl", "terms", "tfs").mapInArrow(_blocks, f"term string, keys array<{kind}>, counts array<bigint>")


def _rows(blocks: DataFrame) -> DataFrame:
    rows = blocks.select("term", F.inline(F.arrays_zip("keys", "counts")).alias("key", "count"))
    return rows.select("term", "key", F.shiftright("count", 32).alias("dl"), F.col("count").bitwiseAND((1 << 32) - 1).alias("tf"))


def by_term(counts: DataFrame) -> DataFrame:
    """(term, key, dl, tf): the postings of ``counts(key, dl, terms, tfs)``, dealt and sorted by term. A term that most documents hold is dealt to several files.

    Postings of one term leave a task together, so that a shuffled row is up to ``RUN`` of them and not one. It is for what is written once and asked often.
    """
    return _rows(_made(counts).repartitionByRange(F.col("term"), F.xxhash64(F.col("keys")[0])).sortWithinPartitions("term", F.col("keys")[0]))


def in_runs(counts: DataFrame) -> DataFrame:
    """(term, key, dl, tf): the same postings in runs of ``CHUNK``, which each task sorts by term. It is for what is merged again: nothing is shuffled, and one run is held.

    What is written from it is a file for each task, of one or a few runs; a reader of a few terms skips the pages of all others by Parquet's statistics of pages.
    """
    return _rows(_made(counts))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pc.split_pattern(batch.column("terms"), " ").flatten().value_counts()
        yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["term", "df"])


def frequencies(counts: DataFrame) -> DataFrame:
    """(term, df): how many rows of ``counts(dl, terms)`` say each term, a row for each batch that holds it."""
    return counts.filter("dl > 0").select("terms").mapInArrow(_frequencies, "term string, df bigint")


def idf(terms: DataFrame, n: DataFrame) -> DataFrame:
    """(term, df, idf): Okapi idf; negative values become ``EPSILON`` times the mean over all terms. n: one row (n)."""
    raw = terms.join(F.broadcast(n)).select("term", "df", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def asked(spark: SparkSession, query: str) -> Counter[str]:
    """The words of a question, with their counts."""
    return Counter(spark.range(1).select(tokens(F.lit(query)).alias("w")).first()["w"])


def local(spark: SparkSession, rows: list, schema: StructType) -> DataFrame:
    """A few collected rows as a table that lies in the plan: by Arrow, so that no Python worker reads them back."""
    return spark.createDataFrame(pa.Table.from_pylist([r.asDict() for r in rows], schema=to_arrow_schema(schema)), schema)


def build_index(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> "Index":
    """Stores the index of ``docs`` below ``path``, which must not exist, and opens it."""
    spark = docs.sparkSession
    if repeats(docs, key):
        # rows of one key and length are one document
        flat = postings(docs, key, text).filter("term is not null").repartitionByRange(F.col("term"), F.xxhash64("key")).sortWithinPartitions("term", "key").select("term", "key", "dl", "tf")
        lengths = docs.select(F.col(key).alias("key"), F.size(tokens(F.col(text))).cast("long").alias("dl")).groupBy("key").agg(F.max("dl").alias("dl"))
        lengths.write.parquet(f"{path}/lengths")
    else:
        counted(docs, key, text).write.option("compression", "zstd").parquet(f"{path}/lengths")
        flat = by_term(spark.read.parquet(f"{path}/lengths"))
    flat.write.option("compression", "zstd").parquet(f"{path}/postings")
    counted_terms, lengths = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths")
    stats = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    terms = idf(counted_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats.select("n"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    stats.write.parquet(f"{path}/stats")
    return Index(spark, path)


@dataclass(frozen=True)
class Index:
    """A stored index: ``postings`` (term, key, dl, tf), ``lengths`` (key, dl, and beside them what ``counted`` gives), ``terms`` (term, df, idf) and one row of ``stats``."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def weights(self, query: str) -> dict[str, float]:
        """The weight of each word of the question that the index knows: its idf, as often as the question says it."""
        words = asked(self.spark, query)
        known = self.table("terms").filter(F.col("term").isin(*words)).select("term", "idf").collect() if words else []  # at most the question's words
        return {r.term: words[r.term] * r.idf for r in known}

    def hits(self, weights: dict[str, float]) -> DataFrame:
        """(key, score) of the documents that hold a word of the question."""
        if not weights:
            return self.table("lengths").select("key", F.lit(0.0).alias("score")).limit(0)
        found = self.table("postings").filter(F.col("term").isin(*weights))
        weight = F.lit(0.0)
        for term, w in sorted(weights.items()):
            weight = F.when(F.col("term") == term, F.lit(float(w))).otherwise(weight)
        scale = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
        part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + scale)
        return found.join(F.broadcast(self.table("stats").select("avgdl"))).groupBy("key").agg(F.sum(part).alias("score"))

    def scores(self, query: str) -> DataFrame:
        """(key, score) of every document, 0 where no word of the question occurs."""
        return self.table("lengths").select("key").join(self.hits(self.weights(query)), "key", "left").select("key", F.coalesce("score", F.lit(0.0)).alias("score"))

    def top(self, query: str, k: int = 10, digits: int = 6) -> DataFrame:
        """(key, score): the ``k`` best documents by rounded score and key. Those without a word of the question are read only where hits are too few, or worth less than none."""
        weights = self.weights(query)
        rounded = lambda df: top(df.select("key", F.round("score", digits).alias("score")), k, "key")
        if all(w > 0 for w in weights.values()):
            best = rounded(self.hits(weights).filter(F.round("score", digits) > 0))
            found = best.collect()  # k rows
            if len(found) == k:
                return local(self.spark, found, best.schema)
        return rounded(self.scores(query))


def bm25(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every document, 0 where no query word occurs. A word that the query repeats counts so often.

    Per-document counts of the few query words are array expressions over the words of the row: no postings are shuffled.
    Document frequencies of *all* terms are aggregated, since the floor of negative idf values is their mean.
    """
    words_asked = asked(docs.sparkSession, query)
    # exploding a list of one keeps the optimizer from cutting the text into words anew for each use of them
    words = docs.select(key, F.explode(F.array(tokens(F.col(text)))).alias("words"))
    stats = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("avgdl"))
    # stop words go behind the explode, where the filter is compiled
    flat = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK))).alias("term"))
    counts = flat.filter((F.col("term") != "") & ~F.col("term").isin(*STOP_WORDS)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = idf(counts, stats.select("n")).filter(F.col("term").isin(*words_asked))
    weights = known.agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idf"))  # at most as many as the query has words
    hits = F.filter("words", lambda w: w.isin(*words_asked)) if words_asked else F.array().cast("array<string>")
    rows = words.select(key, F.size("words").alias("dl"), hits.alias("hits")).join(F.broadcast(stats.select("avgdl"))).join(F.broadcast(weights))

    def part(term: str, times: int) -> Column:
        tf = F.size(F.filter("hits", lambda w: w == term)).cast("double")
        scale = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
        return times * F.coalesce(F.try_element_at(F.col("idf"), F.lit(term)) * tf * (K1 + 1) / (tf + scale), F.lit(0.0))

    score = F.lit(0.0)
    for term, times in sorted(words_asked.items()):
        score = score + part(term, times)
    return rows.select(key, score.alias("score"))


def top(scored: DataFrame, k: int, *ties: str, score: str = "score") -> DataFrame:
    """The ``k`` best rows, ties by the given columns: a top-k without a full sort."""
    return scored.orderBy(F.desc(score), *ties).limit(k)


def keyword_search(docs: DataFrame, query: str, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    return top(bm25(docs, query, key, text), k, key)


def vector_search(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(key, score): the ``k`` vectors of the largest cosine with one query vector, exactly."""
    scored = vectors.select(key, F.round(cosine(F.col(embedding), F.array(*[F.lit(float(x)) for x in query])), 6).alias("score"))
    return top(scored, k, key)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, key: str = "vec_id", embedding: str = "embedding", digits: int = 6) -> DataFrame:
    """(query, key, score, rank): the ``k`` nearest vectors of each query but itself, exactly, by rounded cosine and then key.

    Both sides are packed into blocks of ``BLOCK`` rows; a pair of blocks is one matrix product, which keeps the best ``k``
    of each query, so that only ``k`` rows a query and block are shuffled. Rows of a null key or vector are left out.
    It is exact, and its work grows as queries times vectors.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for i in range(0, len(batch), BLOCK):
                    part = batch.iloc[i : i + BLOCK]
                    m = np.stack([np.asarray(v, np.float64) for v in part["v"]])
                    length = np.linalg.norm(m, axis=1, keepdims=True)
                    m = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
                    yield pd.DataFrame({f"{name}_ids": [part["id"].to_numpy(np.int64).tobytes()], f"{name}_rows": [m.tobytes()]})

        rows = df.filter(F.col(key).isNotNull() & F.col(embedding).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v"))
        return rows.mapInPandas(run, f"{name}_ids binary, {name}_rows binary")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q_ids, q_rows, c_ids, c_rows in zip(batch["q_ids"], batch["q_rows"], batch["c_ids"], batch["c_rows"]):
                q, c = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
                cos = np.round(np.frombuffer(q_rows).reshape(len(q), -1) @ np.frombuffer(c_rows).reshape(len(c), -1).T, digits) + 0.0
                cos[q[:, None] == c[None, :]] = -np.inf
                for i in range(len(q)):
                    best = np.lexsort((c, -cos[i]))[:k] if len(c) <= 4 * k else (p := np.flatnonzero(cos[i] >= np.partition(cos[i], -k)[-k]))[np.lexsort((c[p], -cos[i, p]))[:k]]
                    best = best[np.isfinite(cos[i, best])]
                    yield pd.DataFrame({"query": q[i], key: c[best], "score": cos[i, best]})

    # queries stand on the side that is replayed for each block of vectors
    pairs = packed(vectors, "c").crossJoin(packed(queries, "q"))
    found = pairs.select("q_ids", "q_rows", "c_ids", "c_rows").mapInPandas(compared, f"query long, {key} long, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, name: str = "name", weights: tuple[float, float] = WEIGHTS, normalize: str | None = None) -> DataFrame:
    """(name, score): weighted sums of the scores of hits of one name from two lists of (name, score); a missing side counts 0.

    ``normalize="minmax"`` scales each list to 0..1 first; the default adds raw scores.
    """

    def weighed(hits: DataFrame, w: float) -> DataFrame:
        score = F.col("score")
        if normalize == "minmax":
            all_rows = W.partitionBy(F.lit(0))  # hits are a top-k
            low, high = F.min(score).over(all_rows), F.max(score).over(all_rows)
            score = F.when(high > low, (score - low) / (high - low)).otherwise(1.0)
        return hits.select(name, (score * w).alias("score"))

    return weighed(vector_hits, weights[0]).unionByName(weighed(keyword_hits, weights[1])).groupBy(name).agg(F.sum("score").alias("score"))


def hybrid_search(vector_hits: DataFrame, keyword_hits: DataFrame, k: int = 10, name: str = "name", **how) -> DataFrame:
    return top(hybrid(vector_hits, keyword_hits, name, **how), k, name)
