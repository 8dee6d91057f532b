"""Replay of call stacks in chunks: traces without depths, and runs of any length.

A stack is matching of brackets. Events are dealt to chunks by range of (run, seq), so that one long run is many chunks.
Of a chunk only its change of height and its lowest height matter to the others: they combine associatively, in one row a
run and chunk. With the height that a chunk starts at, every event has its own, and a return goes to the last call one
level below it: mostly of its own chunk. What a chunk leaves open meets the returns of later chunks that found no call, as
rows counted by level, so that no window holds the events of a run.

Defined results: a return from an empty stack changes nothing and has depth -1; calls that never return are no pair; pairs
with a null name are left out, but a call without a name is on the stack all the same; events other than calls and returns
are left out; ``seq`` tells the events of a run apart. An empty trace has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.session import shared_path


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_depth(events: DataFrame, run: str = "run", chunks: int | None = None) -> DataFrame:
    """Calls and returns (run, seq, event, func) with ``chunk``, ``height`` (of the stack after them) and ``depth`` (as a profiler states it: of the frame itself, -1 for a return from nothing)."""
    wanted = events.select(run, "seq", "event", "func").filter("event in ('call', 'return')")
    n = chunks or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored, so that a chunk stays what it is when a task runs again
    dealt = _stored(wanted.repartitionByRange(n, run, "seq").withColumn("chunk", F.spark_partition_id()), "replay-chunks")
    order = W.partitionBy(run, "chunk").orderBy("seq")
    step = F.when(F.col("event") == "call", 1).otherwise(-1)
    rows = dealt.withColumn("__sum", F.sum(step).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("__low", F.min("__sum").over(order.rowsBetween(W.unboundedPreceding, -1)))  # null at the first event
    ends = rows.groupBy(run, "chunk").agg(F.max_by("__sum", "seq").alias("total"), F.min("__sum").alias("low"))
    before = W.partitionBy(run).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)  # one row a chunk
    starts = ends.withColumn("__base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    starts = starts.withColumn("__floor", F.least(F.lit(0), F.min(F.col("__base") + F.col("low")).over(before))).select(F.col(run).alias("__run"), F.col("chunk").alias("__chunk"), "__base", "__floor")
    at = F.col("__base") + F.col("__sum")
    floor = F.least("__floor", F.col("__base") + F.col("__low"))  # the lowest before the event; nulls do not count
    height = at - F.least(floor, at)
    depth = F.when(F.col("event") == "call", height - 1).when(at < floor, -1).otherwise(height)
    on = F.col(run).eqNullSafe(F.col("__run")) & (F.col("chunk") == F.col("__chunk"))
    return rows.join(starts, on).select(run, "chunk", "seq", "event", "func", height.alias("height"), depth.cast("int").alias("depth"))


def call_pairs(events: DataFrame, run: str = "run", chunks: int | None = None) -> DataFrame:
    """(caller, callee, n): how often each function returned to each caller, from the order of events alone."""
    placed = with_depth(events, run, chunks).filter("height > 0")
    called = F.when(F.col("event") == "call", F.struct("func"))
    last = F.last(called, ignorenulls=True).over(W.partitionBy(run, "chunk", "height").orderBy("seq").rowsBetween(W.unboundedPreceding, 0))
    returned = F.col("event") == "return"
    # of calls, the last of a level; of returns, how many go to each caller
    parts = placed.select(run, "chunk", "height", "seq", "func", returned.alias("returned"), F.when(returned, last).alias("caller"))
    parts = parts.withColumn("callee", F.when(F.col("returned"), F.col("func"))).groupBy(run, "chunk", "height", "returned", "caller", "callee")
    counted = _stored(parts.agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("func"), "seq").alias("open")), "replay-counts")
    unmet = counted.filter("not returned or caller is null").withColumn("open", F.when(~F.col("returned"), F.col("open")))
    earlier = W.partitionBy(run, "height").orderBy("chunk").rangeBetween(W.unboundedPreceding, -1)
    late = unmet.withColumn("caller", F.last("open", ignorenulls=True).over(earlier)).filter("returned")
    found = counted.filter("returned and caller is not null").select("caller", "callee", "n").unionByName(late.select("caller", "callee", "n"))
    pairs = found.select(F.col("caller.func").alias("caller"), "callee", "n").filter("caller is not null and callee is not null")
    return pairs.groupBy("caller", "callee").agg(F.sum("n").alias("n"))
