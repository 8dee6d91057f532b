"""A keyword index that follows changes: segments of postings, deletions by document, frequencies by deltas, merges by tiers.

A batch of documents that came, changed or went is one new segment; no segment that stands is written again. Its tables:

* ``keyword_postings``: words of the documents that came, in runs that are sorted by term (``search.in_runs``);
* ``keyword_docs``: the same documents with their different words and how often they say them, dealt by key, so that a later batch learns which words go with a document;
* ``keyword_dead``: documents that an earlier segment holds and this one replaces or removes: what stands there below its number counts no more;
* ``keyword_terms``: by how much the document frequency of each term of the batch rose or fell.

Two small tables are replaced whole: how many terms have each document frequency, from which the mean inverse frequency of all
terms follows without reading them, and one row of totals. ``FANOUT`` segments of a level become one of the next, without what is
dead in them, so that a document is written again as often as the logarithm of their number says, and a question reads few
segments. All of a batch, and a merge, is one commit of the store.

``LiveIndex`` answers as ``search.Index`` does, and as an index does that is built anew over the documents that stand.

Defined results: of rows of one key in a batch, the largest text counts; a key that comes and goes in one batch comes; rows without
a key are left out; a null text has no words; a key that goes and was never there changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators import search
from brindle.session import shared_path
from brindle.sources.sinks import Staged, Store

#: Segments of one level that become one of the next; parts of a segment's documents by key.
FANOUT, BUCKETS = 4, 64
#: Postings of a page of a file, which is what a question reads of each run for each of its words at least.
PAGE = {"parquet.page.row.count.limit": 2000}
POSTINGS, DOCS, DEAD, TERMS, FREQUENCIES, TOTALS = (f"keyword_{t}" for t in ("postings", "docs", "dead", "terms", "frequencies", "totals"))
Parts = dict[str, tuple[DataFrame | Staged, str, list[str]]]


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("string")


def segments(store: Store) -> list[tuple[int, int]]:
    """(number, level) of each segment, oldest first."""
    names = {p.split("-")[0] for t in (POSTINGS, DOCS, DEAD, TERMS) for p in store.parts(t)}
    return sorted(tuple(map(int, n.split("_"))) for n in names)


def _name(number: int, level: int) -> str:
    return f"{number:010d}_{level}"


def _parts(store: Store, table: str, names: set[str] | None = None, buckets: set[str] | None = None) -> list[str]:
    """The parts of a table that belong to segments ``names`` and hold ``buckets``."""
    split = [(p, *p.partition("-")[::2]) for p in store.parts(table)]
    return [p for p, segment, bucket in split if (names is None or segment in names) and (buckets is None or bucket in buckets)]


def _alive(rows: DataFrame, dead: DataFrame) -> DataFrame:
    """Rows (key, segment) that no later segment replaced or removed."""
    gone = dead.select(F.col("key").alias("__key"), "below")
    return rows.join(gone, (F.col("key") == F.col("__key")) & (F.col("segment") < F.col("below")), "left_anti")


def changes(store: Store, docs: DataFrame, gone: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> tuple[dict[str, DataFrame], Parts]:
    """What to commit, as whole tables and as parts, when ``docs(key, text)`` come or change and ``gone(key)`` go."""
    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # texts are shuffled only if keys repeat
    came = rows.groupBy("key").agg(F.max("text").alias("text")) if search.repeats(rows, "key") else rows
    number = max((n for n, _ in segments(store)), default=-1) + 1
    part, of_batch = _name(number, 0), F.lit(number).cast("long").alias("segment")
    dealt = lambda df: df.withColumn("part", F.concat(F.lit(f"{part}-"), _bucket(F.col("key")))).hint("rebalance", "part")
    held = store.stage(DOCS, dealt(search.counted(came, "key", "text")).withColumn("segment", of_batch), "part")
    new = held.rows
    listed = store.stage(POSTINGS, search.in_runs(new).withColumn("segment", of_batch), None, part, **PAGE)
    old, terms = new.select("key", "dl", "segment").limit(0), None
    said = search.frequencies(new)
    if store.exists(DOCS):
        touched = new.select("key")
        if gone is not None:
            touched = touched.unionByName(gone.filter(F.col(key).isNotNull()).select(F.col(key).alias("key")))
        touched = _stored(touched.distinct(), "keyword-touched")
        buckets = {r[0] for r in touched.select(_bucket(F.col("key"))).distinct().collect()}  # at most BUCKETS
        there = store.read(DOCS, _parts(store, DOCS, buckets=buckets))
        # which documents go is found without their words, and their words are read once
        old, terms = _stored(_alive(there.select("key", "dl", "segment").join(touched, "key", "left_semi"), store.read(DEAD)), "keyword-old"), store.read(TERMS)
        words = there.select("key", "segment", "dl", "terms").join(old.select("key", "segment"), ["key", "segment"], "left_semi")
        said = said.unionByName(search.frequencies(words).select("term", (-F.col("df")).alias("df")))
    said = said.select("term", "df", F.lit(0).cast("long").alias("was"))
    if terms is not None:
        # what terms had meets how they change in one shuffle
        said = said.unionByName(terms.select("term", F.lit(0).cast("long").alias("df"), F.col("df").alias("was")))
    risen = _stored(said.groupBy("term").agg(F.sum("df").cast("long").alias("df"), F.sum("was").cast("long").alias("was")).filter("df <> 0"), "keyword-risen")
    moves = risen.select(F.explode(F.array(F.struct(F.col("was").alias("df"), F.lit(-1).alias("n")), F.struct((F.col("was") + F.col("df")).alias("df"), F.lit(1).alias("n")))).alias("m")).select("m.*")
    if store.exists(FREQUENCIES):
        moves = moves.unionByName(store.read(FREQUENCIES))
    frequencies = _stored(moves.filter("df > 0").groupBy("df").agg(F.sum("n").cast("long").alias("n")).filter("n <> 0"), "keyword-frequencies")
    sums = new.select("dl", F.lit(1).alias("n")).unionByName(old.select((-F.col("dl")).alias("dl"), F.lit(-1).alias("n"))).select(F.col("n").cast("long"), F.col("dl").alias("words"))
    if store.exists(TOTALS):
        sums = sums.unionByName(store.read(TOTALS).select("n", "words"))
    totals = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum("words"), F.lit(0)).cast("long").alias("words"))
    raw = F.ln(F.col("all") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    mean = frequencies.join(F.broadcast(totals.select(F.col("n").alias("all")))).agg((F.sum(raw * F.col("n")) / F.sum("n")).alias("mean"))
    whole = {FREQUENCIES: frequencies, TOTALS: totals.join(F.broadcast(mean))}
    return whole, {
        POSTINGS: (listed, "part", []),
        DOCS: (held, "part", []),
        DEAD: (old.select("key", of_batch.alias("below")).withColumn("part", F.lit(part)), "part", []),
        TERMS: (risen.select("term", "df", F.lit(part).alias("part")).repartitionByRange("term").sortWithinPartitions("part", "term"), "part", []),
    }


def merge(store: Store) -> int:
    """Merges the last ``FANOUT`` segments while they are of one level; how many merges that were. Each is one commit."""
    merges = 0
    while True:
        every = segments(store)
        last = every[-FANOUT:]
        if len(last) < FANOUT or len({level for _, level in last}) > 1:
            return merges
        number, level = last[-1]
        names, part = {_name(*s) for s in last}, _name(number, level + 1)
        of_merged = F.lit(number).cast("long").alias("segment")
        dead = store.read(DEAD, list(names))
        rows = lambda t: store.read(t, _parts(store, t, names))
        docs = _alive(rows(DOCS), dead).select("key", "dl", "terms", "tfs", of_merged).withColumn("part", F.concat(F.lit(f"{part}-"), _bucket(F.col("key")))).hint("rebalance", "part")
        held = store.stage(DOCS, docs, "part")
        listed = store.stage(POSTINGS, search.in_runs(held.rows).withColumn("segment", of_merged), None, part, **PAGE)
        risen = rows(TERMS).groupBy("term").agg(F.sum("df").cast("long").alias("df")).filter("df <> 0").withColumn("part", F.lit(part))
        # what is dead in the oldest segment is gone; else older segments may still hold it
        still = (dead.limit(0) if len(last) == len(every) else dead.groupBy("key").agg(F.max("below").alias("below"))).withColumn("part", F.lit(part))
        replaced = lambda t: _parts(store, t, names)
        store.commit(parts={
            POSTINGS: (listed, "part", replaced(POSTINGS)), DOCS: (held, "part", replaced(DOCS)), DEAD: (still, "part", replaced(DEAD)),
            TERMS: (risen.repartitionByRange("term").sortWithinPartitions("part", "term"), "part", replaced(TERMS)),
        })
        merges += 1


def apply(store: Store, docs: DataFrame, gone: DataFrame | None = None, key: str = "doc_id", text: str = "text", batch: int | None = None, source: str = "keywords") -> None:
    """Brings a batch into the index of a store, and merges segments. A batch of a number that was committed before is not applied again."""
    last = store.batch(source)
    if batch is None or last is None or batch > last:
        whole, parts = changes(store, docs, gone, key, text)
        store.commit(whole, parts, batch, source)
    merge(store)


@dataclass(frozen=True)
class LiveIndex(search.Index):
    """The index that the store at ``path`` keeps, with the tables of ``search.Index`` as views of its segments."""

    def table(self, name: str) -> DataFrame:
        store = Store(self.spark, self.path)
        totals = store.read(TOTALS)
        if name == "stats":
            return totals.select("n", (F.col("words") / F.col("n")).alias("avgdl"))
        if name == "terms":
            df = store.read(TERMS).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
            raw = F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
            return df.join(F.broadcast(totals)).select("term", "df", F.when(raw < 0, search.EPSILON * F.col("mean")).otherwise(raw).alias("idf"))
        rows = _alive(store.read(POSTINGS if name == "postings" else DOCS), store.read(DEAD))
        return rows.select("term", "key", "dl", "tf") if name == "postings" else rows.select("key", "dl")
