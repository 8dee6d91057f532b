"""An inverted file of vectors: every vector in the list of its nearest centroid; a question reads a few lists and compares what they hold.

Centroids are fitted to a sample of at most ``SAMPLE`` vectors; *every* vector is indexed. Lists are stored sorted, so that Parquet's
statistics skip those that a question doesn't probe, and a large list spans many files. Beside each list stands its radius, the
largest angle between the centroid and a member. By the triangle inequality no member is nearer to a question than the centroid's
angle less the radius: ``exact`` answers probe the nearest lists first and then those alone that may still hold a better vector, which are all
others only where vectors have no clusters. Without it answers are approximate: the share that they find is a matter of ``probes``.

Vectors that come later are added to the lists as they are; lists grow, radii with them. Rows without a key or vector are left out;
a zero vector has a cosine of 0 with all; equal scores stand by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions.vectors import cosine

#: Vectors that centroids are fitted to, at most, and rounds of that; lists, at most: a list and its centroid for each square root of the vectors.
SAMPLE, FITS, MAX_LISTS = 50_000, 10, 4096
PROBES = 8
#: Rows of a block of vectors and of questions that are compared at once, and tasks that the blocks of one list are dealt to.
BLOCK, ASKED, SALTS = 2048, 512, 8
#: Bytes of questions, about, that a task sends to their lists at once.
BYTES = 8 << 20
DIGITS = 6
#: Angles, in radians, that a rounded score may be off.
SLACK = 2e-3


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def fit(sample: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of unit vectors: spherical k-means. A centroid that loses all its members starts again at the vector that fits worst."""
    draw = np.random.default_rng(seed)
    centroids = sample[draw.choice(len(sample), lists, replace=False)]
    for _ in range(FITS):
        near = sample @ centroids.T
        own, best = near.argmax(1), near.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = sample[np.argsort(best, kind="stable")[: len(empty)]]
        centroids = unit(sums)
    return centroids


def _assigned(centroids: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                near = unit(np.stack([np.asarray(v, np.float64) for v in batch["v"]])) @ centroids.T
                yield batch.assign(list=near.argmax(1), angle=angles(near.max(1)))

    return run


def _packed(size: int, salts: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows of one list as blocks of ids and vectors of length one, dealt to the tasks of their list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, own in batch.groupby("list", sort=False):
                for i in range(0, len(own), size):
                    part = own.iloc[i : i + size]
                    ids, rows = part["id"].to_numpy(np.int64).tobytes(), unit(np.stack([np.asarray(v, np.float64) for v in part["v"]]))
                    yield pd.DataFrame({"list": [number], "salt": [crc32(ids) % salts[number]], "ids": [ids], "rows": [rows.tobytes()]})

    return run


def _compared(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best ``k`` of each pair of blocks, for each question. Blocks are read where they lie in their batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_rows, ids, rows = (batch.column(c)[i].as_buffer() for c in ("q_ids", "q_rows", "ids", "rows"))
                q, c = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                score = np.round(np.frombuffer(q_rows).reshape(len(q), -1) @ np.frombuffer(rows).reshape(len(c), -1).T, DIGITS) + 0.0
                score[q[:, None] == c[None, :]] = -np.inf
                order = np.argsort(c, kind="stable")  # ties by key
                best = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, :k]]
                kept = np.take_along_axis(score, best, axis=1)
                asked, found = np.repeat(q, best.shape[1]), c[best].ravel()
                real = np.isfinite(kept.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(asked[real]), pa.array(found[real]), pa.array(kept.ravel()[real])], ["query", "key", "score"])

    return run


@dataclass(frozen=True)
class VectorIndex:
    """A stored index: ``lists`` (list, id, v, angle) and ``stats`` (list, n, radius) of what was added, and the ``centroids``."""

    spark: SparkSession
    path: str
    centroids: np.ndarray

    def stats(self) -> pd.DataFrame:
        """(n, radius) by list, at most ``MAX_LISTS`` rows."""
        rows = self.spark.read.parquet(f"{self.path}/stats").groupBy("list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
        return rows.toPandas().set_index("list").reindex(range(len(self.centroids))).fillna({"n": 0, "radius": -np.inf})

    def add(self, vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> None:
        """Indexes ``vectors`` beside those that are there."""
        rows = _rows(vectors, key, embedding)
        kind = rows.schema["v"].dataType.simpleString()
        own = rows.mapInPandas(_assigned(self.centroids), f"id long, v {kind}, list int, angle double")
        own.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list", "id").write.mode("append").parquet(f"{self.path}/lists")
        # lists are counted from what is stored; rows of a count replace none, since sums and maxima are taken over all
        done = self.spark.read.parquet(f"{self.path}/stats") if _exists(self.spark, f"{self.path}/stats") else None
        now = self.spark.read.parquet(f"{self.path}/lists").groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
        if done is not None:
            before = done.groupBy("list").agg(F.sum("n").alias("before"))
            now = now.join(before, "list", "left").select("list", (F.col("n") - F.coalesce("before", F.lit(0))).alias("n"), "radius").filter("n > 0")
        now.coalesce(1).write.mode("append").parquet(f"{self.path}/stats")  # at most MAX_LISTS rows

    def _held(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def top(self, query: list[float], k: int = 10, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """(key, score): the best ``k`` of the ``probes`` nearest lists by rounded cosine; with ``exact`` of all."""
        q = unit(np.asarray([query], np.float64))
        away, stats = angles(q @ self.centroids.T)[0], self.stats()
        order = [int(i) for i in np.argsort(away, kind="stable") if stats["n"][i] > 0]
        scored = lambda lists: self._held().filter(F.col("list").isin(lists)).select(F.col("id").alias("key"), F.round(cosine(F.col("v"), F.array(*[F.lit(float(x)) for x in query])), DIGITS).alias("score")).orderBy(F.desc("score"), "key").limit(k)
        first = order[:probes]
        if not exact or len(first) == len(order):
            return scored(first)
        found = scored(first).collect()  # k rows
        reach = np.pi if len(found) < k else float(angles(np.array(found[-1].score))) + SLACK
        return scored(first + [i for i in order[probes:] if away[i] - stats["radius"][i] <= reach])

    def nearest(self, queries: DataFrame, k: int = 5, key: str = "vec_id", embedding: str = "embedding", probes: int = PROBES, exact: bool = False) -> DataFrame:
        """(query, key, score, rank): the best ``k`` of each query but itself, of the ``probes`` nearest lists; with ``exact`` of all.

        A question meets the vectors of its lists alone. Both sides are packed into blocks, so that a meeting is one matrix product that
        keeps ``k`` rows a question; blocks of a list are dealt to at most ``SALTS`` tasks. Questions leave a task in blocks, of ``BYTES`` at once.
        """
        stats, centroids = self.stats(), self.centroids
        filled, radius = stats["n"].to_numpy() > 0, stats["radius"].to_numpy()
        salts = np.clip(-(-stats["n"].to_numpy().astype(np.int64) // BLOCK), 1, SALTS)  # a list of one block is one task's

        def probed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch) or not len(centroids):
                    continue
                for i in range(0, len(batch), ASKED):
                    part = batch.iloc[i : i + ASKED]
                    ids, rows = part["id"].to_numpy(np.int64), unit(np.stack([np.asarray(v, np.float64) for v in part["v"]]))
                    away = angles(rows @ centroids.T)
                    away[:, ~filled] = np.inf
                    rank = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1, kind="stable")
                    hit = (rank < probes) & np.isfinite(away)
                    if "reach" in part:  # what the first lists did not settle
                        hit = ~hit & (away - radius[None, :] <= part["reach"].to_numpy()[:, None])
                    lists = np.flatnonzero(hit.any(0))
                    for some in np.array_split(lists, -(-len(lists) * rows.nbytes // BYTES) or 1):  # where lists are wide, all questions ask all lists
                        yield pd.DataFrame({"list": some, "salts": salts[some], "q_ids": [ids[hit[:, n]].tobytes() for n in some], "q_rows": [rows[hit[:, n]].tobytes() for n in some]})

        rows = _rows(queries, key, embedding)

        def met(asked: DataFrame) -> DataFrame:
            asked = asked.mapInPandas(probed, "list int, salts int, q_ids binary, q_rows binary")
            asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
            held = self._held().select("list", "id", "v").mapInPandas(_packed(BLOCK, salts), "list int, salt int, ids binary, rows binary")
            return held.join(asked, ["list", "salt"]).select("q_ids", "q_rows", "ids", "rows").mapInArrow(_compared(k), "query long, key long, score double")

        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))
        best = lambda found: found.withColumn("rank", place.cast("long")).filter(F.col("rank") <= k)
        found = best(met(rows))
        if not exact:
            return found
        last = found.filter(F.col("rank") == k).select(F.col("query").alias("id"), (F.acos("score") + SLACK).alias("reach"))
        open_ = rows.join(last, "id", "left").select("id", "v", F.coalesce("reach", F.lit(float(np.pi) + SLACK)).alias("reach"))
        return best(found.drop("rank").unionByName(met(open_)))


def _rows(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    return vectors.filter(F.col(key).isNotNull() & F.col(embedding).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(embedding).alias("v"))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def build(vectors: DataFrame, path: str, key: str = "vec_id", embedding: str = "embedding", lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Stores the index of ``vectors`` below ``path``, which must not exist, and opens it."""
    spark, rows = vectors.sparkSession, _rows(vectors, key, embedding)
    n = rows.count()
    some = rows if n <= sample else rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * sample / n)))
    drawn = [r[0] for r in some.select("v").limit(sample).collect()]  # at most ``sample`` rows
    lists = min(lists or max(1, round(n**0.5)), MAX_LISTS, len(drawn))
    centroids = fit(unit(np.array(drawn, np.float64)), lists) if drawn else np.zeros((0, 0))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>").write.parquet(f"{path}/centroids")
    index = VectorIndex(spark, path, centroids)
    index.add(vectors, key, embedding)
    return index


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``build`` stored."""
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # at most MAX_LISTS
    return VectorIndex(spark, path, np.array([r.centroid for r in rows], np.float64))
