"""A Merkle manifest of a dataset: leaves of rows, a tree for each group, one root, and proofs.

A leaf hashes a row's columns; the leaves of a group (``lang``) ascend by key, and every ``FAN`` consecutive nodes become
the hash of their digests until one is left, the group's subroot; subroots in the order of their groups likewise give the
root. A proof is the siblings of a leaf from level to level.

Spark hashes leaves in the scan and ranks them within their groups by range, so that a group with most of the rows lies
in many tasks. Places are cut into *aligned* buckets of ``FAN ** LEVELS`` nodes, each a whole subtree: an executor hands
a bucket as Arrow to DuckDB, whose ordered string_agg and sha256 make its levels. The roots of the buckets are the nodes of the
next tier, which is cut and hashed in the same way, up to the root. Then proofs go down: a bucket meets the one row of
its outer proof, makes its inner siblings again, and folds. No task holds more than a bucket, and no text leaves the scan.

Defined results: a null is hashed as ``-``; a null group is a group of its own and the first; null keys come first, rows
of equal keys stand in the order of their leaves (equal rows are leaves of their own); an empty table has no root and gives an
empty result; extra columns never enter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, stored

FAN = 8
#: Levels that one bucket holds: 4,096 leaves.
LEVELS = 4
BUCKET = FAN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before:string,after:string>>"


def value(c: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 byte count, a colon and itself; ``-`` for null."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[value(c) for c in columns]), 256)


@lru_cache(maxsize=1)
def engine() -> duckdb.DuckDBPyConnection:
    """The worker's own database, in memory."""
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})


def built(db: duckdb.DuckDBPyConnection, nodes: pa.Table, first: bool) -> int:
    """Tables l0, l1, ... of the levels of a bucket ``nodes(i, h)`` in ``db``; how many levels are hashed.

    Aligned buckets are full, but for the last one of a tree. So a tree ends within its first bucket or goes through all levels.
    """
    levels = LEVELS
    if first:
        levels = next(k for k in range(LEVELS + 1) if FAN**k >= nodes.num_rows)
    db.register("bucket", nodes)
    db.execute(f"CREATE OR REPLACE TEMP TABLE l0 AS SELECT i % {BUCKET} AS i, h FROM bucket")
    db.unregister("bucket")
    for k in range(levels):
        db.execute(f"CREATE OR REPLACE TEMP TABLE l{k + 1} AS SELECT i // {FAN} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l{k} GROUP BY i // {FAN}")
    return levels


def beside(db: duckdb.DuckDBPyConnection, levels: int) -> str:
    """Tables s0, s1, ... of what stands before and after each node in its run; SQL that joins them to l0."""
    for k in range(levels):
        db.execute(
            f"CREATE OR REPLACE TEMP TABLE s{k} AS SELECT i, array_to_string(hs[1:i % {FAN}], '') AS before, array_to_string(hs[i % {FAN} + 2:], '') AS after "
            f"FROM l{k} JOIN (SELECT i // {FAN} AS run, list(h ORDER BY i) AS hs FROM l{k} GROUP BY run) r ON i // {FAN} = run"
        )
    return "l0 " + " ".join(f"JOIN s{k} ON s{k}.i = l0.i // {FAN**k}" for k in range(levels))


def _root(key: tuple, nodes: pa.Table) -> pa.Table:
    """The root of one bucket."""
    db, (tree, bucket) = engine(), (k.as_py() for k in key)
    levels = built(db, nodes.select(["i", "h"]), bucket == 0)
    [(h,)] = db.execute(f"SELECT h FROM l{levels}").fetchall()
    return pa.table({"tree": [tree], "i": pa.array([bucket], pa.int64()), "h": [h]})


def _down(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The proofs of the nodes of a bucket: its own levels, then those above it."""
    db, bucket = engine(), key[1].as_py()
    source = beside(db, built(db, nodes.select(["i", "h"]), bucket == 0))
    [outer] = above.column("path").to_pylist()
    levels = source.count("JOIN")
    inner = ", ".join(f"s{k}.before, s{k}.after" for k in range(levels))
    rows = db.execute(f"SELECT l0.i{', ' if levels else ''}{inner} FROM {source} ORDER BY l0.i").fetchall()
    n = len(rows)
    paths = [[{"before": r[1 + 2 * k], "after": r[2 + 2 * k]} for k in range(levels)] + outer for r in rows]
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    same = {c: pa.array(above.column(c).to_pylist() * n, pa.string()) for c in ("tree", "subroot")}
    return pa.table({"tree": same["tree"], "i": pa.array([bucket * BUCKET + r[0] for r in rows], pa.int64()), "path": pa.array(paths, kind), "subroot": same["subroot"]})


def _proved(proofs: bool) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The leaves of a bucket with digests of their proofs, the proofs themselves if asked for, and roots folded from what is claimed."""

    def run(key: tuple, leaves: pa.Table, above: pa.Table) -> pa.Table:
        db = engine()
        source = beside(db, built(db, leaves.select(["i", "h"]), key[1].as_py() == 0))
        levels = source.count("JOIN")
        [outer], [subroot] = above.column("path").to_pylist(), above.column("subroot").to_pylist()
        given = {f"b{k}": x["before"] for k, x in enumerate(outer)} | {f"a{k}": x["after"] for k, x in enumerate(outer)}
        proof = " || ".join(["''", *(f"s{k}.before || s{k}.after" for k in range(levels)), *(f"$b{k} || $a{k}" for k in range(len(outer)))])
        folded = "coalesce(c.claimed, l0.h)"
        for k in range(levels):
            folded = f"sha256(s{k}.before || {folded} || s{k}.after)"
        for k in range(len(outer)):
            folded = f"sha256($b{k} || {folded} || $a{k})"
        db.register("claims", leaves.select(["i", "doc_id", "claimed"]))
        text = ", proof" if proofs else ""
        out = db.sql(f"SELECT doc_id, leaf, sha256(proof) AS proof_sha256, folded_root{text} FROM (SELECT c.doc_id, l0.h AS leaf, {proof} AS proof, {folded} AS folded_root FROM {source} JOIN claims c ON c.i % {BUCKET} = l0.i)", params=given).to_arrow_table()
        db.unregister("claims")
        return out.append_column("subroot", pa.array([subroot] * out.num_rows, pa.string()))

    return run


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """``nodes(tree, i, h)``, then the roots of their buckets, of those of these, until one is left for each tree."""
    tiers = [nodes]
    while True:
        buckets = tiers[-1].select("tree", "i", "h").groupBy("tree", (F.floor(F.col("i") / BUCKET)).cast("long").alias("bucket"))
        tiers.append(stored(buckets.applyInArrow(_root, "tree string, i long, h string"), "merkle-tier"))
        if tiers[-1].filter("i > 0").isEmpty():
            return tiers


def _paths(tiers: list[DataFrame], top: DataFrame, lowest: int) -> DataFrame:
    """(tree, i, path, subroot) of the nodes of tier ``lowest``, from those of the last one, ``top``."""
    for nodes in tiers[-2 : lowest - 1 if lowest else None : -1]:
        top = stored(_met(nodes.select("tree", "i", "h"), top, _down, f"tree string, i long, path {PATH}, subroot string"), "merkle-paths")
    return top


def _met(nodes: DataFrame, above: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``function`` of each bucket of ``nodes`` and its row of ``above``."""
    buckets = nodes.groupBy("tree", F.floor(F.col("i") / BUCKET).cast("long").alias("bucket"))
    return buckets.cogroup(above.groupBy("tree", F.col("i").alias("bucket"))).applyInArrow(function, schema)


@dataclass
class Manifest:
    """Leaves (tree, i, h, doc_id, claimed), their tiers, the trees' subroots (tree, i, path, subroot) and the root, None of an empty table."""

    leaves: DataFrame
    tiers: list[DataFrame]
    subroots: DataFrame
    root: str | None

    def proofs(self, whole: bool = False) -> DataFrame:
        """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each leaf, with ``whole`` its proof as text as well.

        folded_root is made of the claimed leaf, else of the leaf, and the siblings of the manifest.
        """
        above = _paths(self.tiers, self.subroots, 1)
        text = ", proof string" if whole else ""
        rows = _met(self.leaves, above, _proved(whole), f"doc_id long, leaf string, proof_sha256 string, folded_root string{text}, subroot string")
        root = F.lit(self.root).cast("string")
        return rows.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"), *(["proof"] if whole else []))


def build(df: DataFrame, columns: Sequence[str] = COLUMNS, key: str = "doc_id", group: str = "lang", claimed: Column | None = None) -> Manifest:
    """The manifest of ``df``. ``claimed``: a leaf that is held against the manifest instead of a row's own, null for the row's own."""
    name = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))  # null first
    leaves = df.select(name.alias("tree"), F.col(key).cast("long").alias("doc_id"), leaf([F.col(c) for c in columns]).alias("h"), (F.lit(None) if claimed is None else claimed).cast("string").alias("claimed"))
    leaves = stored(leaves, "merkle-rows")  # texts are read once: dealing by range looks at rows twice
    leaves = ranked(leaves, "tree", [F.col("doc_id").asc_nulls_first(), "h"], ["tree", "doc_id", "h", "claimed"], "merkle-leaves").withColumnRenamed("place", "i")
    tiers = _tiers(leaves)
    groups = ranked(tiers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "h"), "tree", ["name"], ["tree", "name", "h"], "merkle-groups").withColumnRenamed("place", "i")
    above = _tiers(groups)
    root = above[-1].first()  # one digest
    top = above[-1].select("tree", "i", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"))
    paths = _paths(above, top, 0).select("i", "path")
    return Manifest(leaves, tiers, groups.join(paths, "i").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("i"), "path", F.col("h").alias("subroot")), root and root.h)


def tampered(columns: Sequence[str] = COLUMNS, key: str = "doc_id", text: str = "text") -> Column:
    """The leaf with A-Z lower-cased in its text, where 3 divides the CRC-32 of its key; null for all other rows and where nothing changes."""
    hit = (F.pmod(F.crc32(F.col(key).cast("string")), F.lit(3)) == 0) & F.col(text).rlike("[A-Z]")
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(lower)  # much faster, and the same for ASCII
    return F.when(hit, leaf([lower if c == text else F.col(c) for c in columns]))


def tamper_check(df: DataFrame) -> DataFrame:
    """The manifest's proofs of ``df``, a third of which is held against it with lower-cased texts."""
    return build(df, claimed=tampered()).proofs()
