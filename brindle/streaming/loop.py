"""The maintenance loop: a stream of file changes keeps the extraction table current, and with it the graph.

The extraction table has a part for each hash of a path. A micro-batch reads and rewrites the parts of the paths that it
touches, and no other: its cost follows the changes, not the repository. Rewritten parts, the symbol changes of the batch
and its number become visible by one pointer (see ``sources.sinks``), so that a batch that is retried after a failure
either finds itself committed, or nothing of it. The graph is a view over the extraction table: names are resolved by two
joins when it is read, since a new definition in one file can add edges between others; ``publish`` stores it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle import schemas
from brindle.functions.structure import extract
from brindle.operators import delta, live_index
from brindle.operators import graph as G
from brindle.operators import symbols as S
from brindle.plans import retrieval
from brindle.session import shared_path
from brindle.sources.sinks import Store

#: Parts of the extraction table. It is fixed with the first batch of a store.
PARTS = 64


@dataclass
class Config:
    max_files_per_batch: int = 1000
    interval: str = "2 seconds"
    #: Seconds to wait before a failed stream is started again, which double up to the last; failures in a row that end it.
    wait: float = 1.0
    longest_wait: float = 60.0
    attempts: int = 5
    repository: str = "repository"
    identity: str = "path"
    resolve: str = "name"
    #: Keeps nodes and edges current with each batch, by deltas; else ``graph`` builds them when it is asked.
    maintain: bool = False
    #: Keeps a keyword index of the symbols current with each batch (``operators.live_index``), by their ids.
    keywords: bool = False


@dataclass
class Metrics:
    processed: int = 0
    failed: int = 0
    symbols: int = 0
    milliseconds: int = 0
    last_batch: int = -1
    last_file: str | None = None
    events: list[tuple[float, str, str]] = field(default_factory=list)

    def log(self, kind: str, message: str) -> None:
        self.events = [*self.events, (time.time(), kind, message)][-100:]


def part_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(PARTS)).cast("string")


def versions(changes: DataFrame) -> DataFrame:
    """(path, n, last, content, gone, origin, went, ts): what each path came to hold in a batch, from its first version, n = 1, on.

    A rename is two versions: its old path goes (``went``: to where), and its new path comes, with content or from its ``origin``. A change
    that is neither a deletion nor a rename and comes without its content says nothing yet. At one time, what goes comes first.
    """
    none = F.lit(None).cast("string")
    renamed = F.col("change_type") == "renamed"
    own = changes.select(F.col("file_path").alias("path"), "ts", "content", F.when(renamed, F.col("old_path")).alias("origin"), (F.col("change_type") == "deleted").alias("gone"), none.alias("went"))
    away = changes.filter(renamed & F.col("old_path").isNotNull()).select(F.col("old_path").alias("path"), "ts", none.alias("content"), none.alias("origin"), F.lit(True).alias("gone"), F.col("file_path").alias("went"))
    every = own.unionByName(away).filter("path is not null and (gone or content is not null or origin is not null)").distinct()
    of_path = W.partitionBy("path")
    n = F.row_number().over(of_path.orderBy("ts", ~F.col("gone"), F.coalesce("content", F.lit("")), "origin", "went"))
    return every.withColumns({"n": n, "last": n == F.count(F.lit(1)).over(of_path)})


def settled(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, content), (path, origin)) of a batch: for each path that changes what it holds in the end, null for nothing; and where that is what another path held before the batch.

    A rename without content takes what its old path held just then: its version points at the one before the old path went.
    Such pointers are joined to each other, which doubles how far they reach, until none leads to a pointer: to a version with
    content, to one that is gone, or to what a path held before the batch (n = 0).
    """
    every = _stored(versions(changes), "versions")
    links = every.filter("content is null and not gone")
    taken = every.sparkSession.createDataFrame([], "path string, given string, origin string")
    if not links.isEmpty():
        before = every.filter("went is not null").select(F.col("path").alias("origin"), F.col("went").alias("path"), "ts", F.col("path").alias("to_path"), (F.col("n") - 1).alias("to_n"))
        links = _stored(links.join(before, ["path", "origin", "ts"]).select("path", "n", "last", "to_path", "to_n"), "links")
        while True:
            further = links.select(F.col("path").alias("to_path"), F.col("n").alias("to_n"), F.col("to_path").alias("far_path"), F.col("to_n").alias("far_n"))
            hops = links.join(further, ["to_path", "to_n"], "left")
            if hops.filter("far_path is not null").isEmpty():
                break
            links = _stored(hops.select("path", "n", "last", F.coalesce("far_path", "to_path").alias("to_path"), F.coalesce("far_n", "to_n").alias("to_n")), "links")
        given = every.select(F.col("path").alias("to_path"), F.col("n").alias("to_n"), F.col("content").alias("given"))
        taken = links.filter("last").join(given, ["to_path", "to_n"], "left").select("path", "given", F.when(F.col("to_n") == 0, F.col("to_path")).alias("origin"))
    last = every.filter("last").drop("origin").join(taken, "path", "left")
    return last.select("path", F.coalesce("content", "given").alias("content")), last.filter("origin is not null").select("path", "origin")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: each of these tables is read several times, and stands on those before."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apply_changes(store: Store, changes: DataFrame, config: Config = Config(), batch: int | None = None, source: str = "") -> DataFrame:
    """Applies a batch of changes (file_path, change_type, ts, old_path, content) and returns its symbol changes.

    A batch of a number that the store has seen from this source, or of an earlier one, is not applied again.
    """
    number = "-".join(filter(None, (source, uuid.uuid4().hex if batch is None else str(batch))))
    last = store.batch(source)
    if batch is not None and last is not None and batch <= last:
        return store.read("symbol_changes", [number])
    held, moved = settled(changes)
    held, moved = held.cache(), moved.cache()
    try:
        paths = held.select("path").union(moved.select(F.col("origin").alias("path"))).distinct()
        parts = [r[0] for r in paths.select(part_of(F.col("path"))).distinct().collect()]  # at most PARTS
        old = store.read("extracted", parts) if store.exists("extracted") else store.spark.createDataFrame([], schemas.EXTRACTED)
        parsed = extract(held.filter("content is not null")).cache()  # two tables are written from it
        came = old.join(moved.withColumnRenamed("path", "__new"), F.col("path") == F.col("origin")).withColumn("path", F.col("__new")).select(*old.columns)
        fresh = parsed.unionByName(came)
        before = S.snapshot(old.join(held, "path", "left_semi"))
        differences = S.diff(before, S.snapshot(fresh)).withColumn("batch", F.lit(number))
        after = old.join(held, "path", "left_anti").unionByName(fresh).withColumn("part", part_of(F.col("path"))).hint("rebalance", "part")  # else each task writes a file into each part
        kept = delta.changes(store, old.join(held, "path", "left_semi"), fresh, held.select("path"), config.repository) if config.maintain else {}
        whole = {}
        if config.keywords:
            now, then = (retrieval.symbol_documents(G.build(x, config.repository)) for x in (fresh, old.join(held, "path", "left_semi")))
            whole, words = live_index.changes(store, now, then.select("id"), "id")
            kept |= words
        store.commit(whole, {"extracted": (after, "part", parts), "symbol_changes": (differences, "batch", [number])} | kept, batch, source)
        if config.keywords:
            live_index.merge(store)
        parsed.unpersist()
    finally:
        held.unpersist(), moved.unpersist()
    return store.read("symbol_changes", [number])


def graph(store: Store, config: Config = Config()) -> G.Graph:
    """The graph of what the store holds now: as it is kept by deltas, or built."""
    if config.maintain:
        return delta.graph(store)
    return G.build(store.read("extracted"), config.repository, config.identity, config.resolve)


def publish(store: Store, config: Config = Config()) -> None:
    """Stores the graph as the tables ``nodes`` and ``edges``, both in one step."""
    now = graph(store, config)
    store.commit({"nodes": now.nodes, "edges": now.edges})


METRICS = "processed long, failed long, symbols long, milliseconds long, last_batch long, last_file string"


class MaintenanceLoop:
    """Starts, pauses, resumes and stops the stream, and tells how it is doing."""

    def __init__(self, source: Callable[[], DataFrame], store: Store, checkpoint: str, config: Config | None = None):
        self.source, self.store, self.checkpoint = source, store, checkpoint
        self.config = config or Config()
        self.metrics = self._load()
        self.query: StreamingQuery | None = None
        self.started = 0.0

    def _batch(self, changes: DataFrame, number: int) -> None:
        began = time.monotonic()
        try:
            seen = changes.agg(F.count(F.lit(1)).alias("n"), F.max_by("file_path", "ts").alias("last")).first()
            n = seen.n
            if n:
                self.metrics.symbols += apply_changes(self.store, changes, self.config, number, self._source()).count()
                self.metrics.last_file = seen.last
            self.metrics.processed += n
            self.metrics.last_batch = number
            self.metrics.log("batch", f"{number}: {n} changes")
        except Exception as e:
            self.metrics.failed += 1
            self.metrics.log("error", str(e)[:500])
            raise
        finally:
            self.metrics.milliseconds += round(1000 * (time.monotonic() - began))
            if self.store.root:
                self._save()

    def _source(self) -> str:
        """The identity of the stream, which its checkpoint keeps: batches of a new checkpoint are counted anew."""
        fs, path = self.store._fs(f"{self.checkpoint.rstrip('/')}/metadata")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["id"]
        finally:
            stream.close()

    def _save(self) -> None:
        """Keeps the metrics beside the checkpoint, so that a loop that is started anew goes on counting."""
        m = self.metrics
        row = [(m.processed, m.failed, m.symbols, m.milliseconds, m.last_batch, m.last_file)]
        self.store.spark.createDataFrame(row, METRICS).coalesce(1).write.mode("overwrite").parquet(f"{self.checkpoint.rstrip('/')}-metrics")

    def _load(self) -> Metrics:
        fs, path = self.store._fs(f"{self.checkpoint.rstrip('/')}-metrics")
        if not fs.exists(path):
            return Metrics()
        rows = self.store.spark.read.schema(METRICS).parquet(f"{self.checkpoint.rstrip('/')}-metrics").take(1)
        return Metrics(**rows[0].asDict()) if rows else Metrics()

    def start(self, available_now: bool = False) -> StreamingQuery:
        if self.query is not None and self.query.isActive:
            return self.query
        writer = self.source().writeStream.foreachBatch(self._batch).option("checkpointLocation", self.checkpoint)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=self.config.interval)
        self.query, self.started = writer.start(), time.time()
        self.metrics.log("start", self.query.id)
        return self.query

    def stop(self) -> None:
        """Stops the stream; the checkpoint keeps its place, so that pausing is stopping and resuming is starting."""
        if self.query is not None:
            self.query.stop()
            self.metrics.log("stop", "")

    pause = stop
    resume = start

    def restart(self) -> StreamingQuery:
        self.stop()
        return self.start()

    def supervise(self, until: Callable[[], bool] = lambda: False) -> int:
        """Keeps the stream running until ``until()``: after a failure it waits, twice as long each time, and starts again. Returns the failures.

        A batch in between ends the row of failures. Raises the failure that is one too many.
        """
        failures = row = 0
        while not until():
            batch = self.metrics.last_batch
            query = self.start()
            try:
                while query.isActive and not until():
                    query.awaitTermination(0.5)
            except Exception as e:
                failures, row = failures + 1, row + 1 if self.metrics.last_batch == batch else 1
                self.metrics.log("failure", str(e)[:500])
                if row >= self.config.attempts:
                    raise
                time.sleep(min(self.config.longest_wait, self.config.wait * 2 ** (row - 1)))
        self.stop()
        return failures

    def status(self) -> dict:
        active = self.query is not None and self.query.isActive
        failure = self.query.exception() if self.query is not None else None
        return {
            "running": active, "healthy": failure is None, "error": str(failure)[:500] if failure else None, "uptime_seconds": time.time() - self.started if active else 0.0,
            "processed": self.metrics.processed, "failed": self.metrics.failed, "symbols": self.metrics.symbols, "milliseconds": self.metrics.milliseconds, "last_file": self.metrics.last_file,
            "progress": self.query.lastProgress if self.query is not None else None,
        }

    def events(self, limit: int = 50) -> list[tuple[float, str, str]]:
        return self.metrics.events[-limit:]

    def configure(self, **settings) -> Config:
        """Changes settings; they hold from the next start."""
        for name, value in settings.items():
            if not hasattr(self.config, name):
                raise ValueError(f"no setting {name}")
            setattr(self.config, name, value)
        return self.config


class ChangeQueue:
    """Changes that wait, first in first out by number, and what became of them; each step is one commit of its store."""

    TABLE, DONE = "queue", "queue_done"

    def __init__(self, store: Store):
        self.store = store
        if not store.exists(self.TABLE):
            empty = store.spark.createDataFrame([], f"seq long, {schemas.CHANGES}")
            store.commit({self.TABLE: empty, self.DONE: store.spark.createDataFrame([], "seq long, ok boolean")})

    def add(self, changes: DataFrame) -> None:
        """Adds changes behind those that wait, in the order of their times and paths."""
        last = self.store.read(self.TABLE).agg(F.max("seq")).first()[0]
        names = [c.split()[0] for c in schemas.CHANGES.split(", ")]
        rows = changes.select(*[F.col(c) if c in changes.columns else F.lit(None).alias(c) for c in names])
        rows = rows.withColumn("ts", F.coalesce(F.col("ts").cast("timestamp"), F.current_timestamp()))
        # ranges of the order, then places in each: no single task holds the queue
        parts = rows.repartitionByRange("ts", "file_path").sortWithinPartitions("ts", "file_path").withColumn("__id", F.monotonically_increasing_id())
        seq = (F.col("__id") + F.lit(0 if last is None else last + 1)).alias("seq")
        self.store.append(self.TABLE, parts.select(seq, *names))

    def pending(self, n: int | None = None) -> DataFrame:
        """The changes that wait, or the first ``n`` of them; they stay."""
        waiting = self.store.read(self.TABLE).join(self.store.read(self.DONE), "seq", "left_anti")
        return waiting if n is None else waiting.orderBy("seq").limit(n)

    def mark(self, done: DataFrame, ok: bool = True) -> None:
        """Marks changes ``done(seq)`` as processed, or as failed."""
        self.store.append(self.DONE, done.select("seq", F.lit(ok).alias("ok")).distinct())

    def consume(self, n: int) -> DataFrame:
        """Takes the first ``n`` changes that wait: they are returned, and wait no more."""
        taken = [r.seq for r in self.pending(n).select("seq").collect()]  # at most n numbers
        self.mark(self.store.spark.createDataFrame([(s,) for s in taken], "seq long"))
        return self.store.read(self.TABLE).filter(F.col("seq").isin(taken) if taken else F.lit(False))

    def clear(self) -> int:
        """Drops what waits; how many changes that was."""
        waiting = self.pending()
        n = waiting.count()
        self.mark(waiting, ok=False)
        return n

    def status(self) -> DataFrame:
        """(change_type, n) of the changes that wait."""
        return queue_status(self.pending())


def queue_status(pending: DataFrame) -> DataFrame:
    """(change_type, n) of changes that wait."""
    return pending.groupBy("change_type").agg(F.count(F.lit(1)).alias("n"))


def enqueue(spark: SparkSession, folder: str, changes: list[dict]) -> None:
    """Adds changes to the landing folder that ``sources.changes.watch`` reads, first in first out by file."""
    rows = [(c["file_path"], c["change_type"], c.get("ts"), c.get("old_path"), c.get("content")) for c in changes]
    spark.createDataFrame(rows, schemas.CHANGES).withColumn("ts", F.coalesce("ts", F.current_timestamp())).coalesce(1).write.mode("append").json(folder)


def peek(spark: SparkSession, folder: str, n: int = 10) -> DataFrame:
    """The first ``n`` changes of the landing folder, which stay there."""
    return spark.read.schema(schemas.CHANGES).json(folder).orderBy("ts", "file_path").limit(n)


def activity(changes: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, change_type, n) of a stream of changes by event time; rows later than ``delay`` are left out of closed windows."""
    ts = F.col("ts").cast("timestamp")
    return changes.withColumn("ts", ts).withWatermark("ts", delay).groupBy(F.window("ts", width), "change_type").agg(F.count(F.lit(1)).alias("n"))
