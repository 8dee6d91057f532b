"""Helpers that several operators share: the shared folder, batches of rows and text columns."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle import session
from brindle.session import shared_root

__all__ = ["joined", "named", "numbered", "ranked", "removed", "scratch", "shared_path", "shared_root", "slices", "stored", "text_of"]

#: Bytes of text that a Python worker holds as objects at once; a longer single text is a batch alone.
BATCH_BYTES = 4 << 20
#: Folders written inside each open ``scratch``, innermost last.
_SCRATCHES: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a table that one call writes and reads again; an open ``scratch`` removes it."""
    path = session.shared_path(spark, name)
    if _SCRATCHES:
        _SCRATCHES[-1].append(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Removes a folder below the shared one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that operators wrote inside to the shared folder: for results that are written before it ends.

    Results are lazy and read those tables, so that operators can't remove them on their own.
    """
    _SCRATCHES.append([])
    try:
        yield
    finally:
        for path in _SCRATCHES.pop():
            removed(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends there and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns called c0, c1 and so on, and these by their own names: no helper column can clash with one."""
    own = {name: f"c{i}" for i, name in enumerate(df.columns)}
    return df.toDF(*own.values()), own


def named(df: DataFrame, own: dict[str, str], **columns: Column) -> DataFrame:
    """The columns of ``numbered`` under their own names again, some of them replaced."""
    return df.select(*[columns.get(name, F.col(c)).alias(name) for name, c in own.items()])


def ranked(df: DataFrame, key: str, order: list[Column | str], keep: list[Column | str], name: str, weight: str | None = None) -> DataFrame:
    """The columns ``keep`` of ``df`` with place, from 0 among the rows of a ``key`` in the given ``order``, and before, the ``weight`` of the rows before.

    ``key`` is without nulls and among ``keep``. Rows are dealt by range of key and order, so that a key with many rows is
    in many tasks; each task counts its own, and a key that lies in several tasks gets the sums of the tasks before.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = df.select(*keep).schema
    names = kept.names
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in ("part", "place", "before")]])
    at, heavy = names.index(key), names.index(weight) if weight else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, rows, total = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(at)
            starts = np.ones(n, bool)
            starts[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(starts)
            own = begin[np.cumsum(starts) - 1]
            size = np.zeros(n, np.int64) if heavy is None else batch.column(heavy).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.cumsum(size) - size
            place, before = np.arange(n) - own, sums - sums[own]
            if keys[0].as_py() == last:
                place[own == 0] += rows
                before[own == 0] += total
            last, rows, total = keys[-1].as_py(), int(place[-1]) + 1, int(before[-1] + size[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(place), pa.array(before)], names=[*names, "part", "place", "before"])

    dealt = df.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).select(*keep)
    local = stored(dealt.mapInArrow(run, schema), name)
    sums = local.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("before") + (F.col(weight) if weight else F.lit(0))).alias("w"))
    whole = W.partitionBy(key)
    earlier = whole.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    spans = sums.select(key, "part", F.count(F.lit(1)).over(whole).alias("tasks"), F.sum("n").over(earlier).alias("n"), F.sum("w").over(earlier).alias("w"))
    # a key lies in two tasks only where these meet: at most two rows a task
    spans = F.broadcast(stored(spans.filter("tasks > 1 and n is not null").drop("tasks"), f"{name}-spans"))
    placed = {"place": F.col("place") + F.coalesce("n", F.lit(0)), "before": F.col("before") + F.coalesce("w", F.lit(0))}
    return local.join(spans, [key, "part"], "left").select(*names, *[c.alias(k) for k, c in placed.items()])


def joined(rows: DataFrame, names: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``names``, which holds each key ``on`` once and in ``weight`` how many of the rows have it.

    Keys of over a thousandth of all rows, which are fewer than a thousand, meet by a broadcast; all others by a shuffle.
    """
    total = names.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * 1000 > F.lit(total)
    hot = names.filter(is_hot)
    if hot.isEmpty():
        return rows.join(names, on, how)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(names.filter(~is_hot), on, how)
    return rows.join(F.broadcast(hot), on, how if how != "left" else "inner").unionByName(cold)


def text_of(name: str) -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator, text: int = 1, limit: int = BATCH_BYTES) -> Iterator:
    """Arrow batches cut so that the text column of each part holds about ``limit`` bytes, or one row."""
    for batch in batches:
        start = size = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
