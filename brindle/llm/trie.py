"""A trie of conversations by their shared prefixes, built level by level, with what serving it once would save.

A node of depth d is a distinct sequence of the first d turns; conversations that begin with it are its members, and the
smallest of their ids with the depth names it. Turns are digests (SHA-256 of role and text) throughout; texts leave with the sort that
puts turns in their order, which deals them by range, so that one conversation may lie in many tasks.

Conversations that are equal as a whole are one *class*, found by a hash that needs no order, so that copies cost a row. Down:
at each depth, live classes are grouped by (parent node, next turn), and the group's smallest conv_id is the new node. A group
of one class is the head of a *chain*: all below it is that class's own turns, which need no further grouping, so that depths
run only as far as different conversations agree. Up: level by level, children are joined to their parents and add up leaves and
savings; a chain's are known from its sums of bytes.

Ids of the members that end at a node are hashed in their numeric order: sorted by range, concatenated in runs of ``RUN`` ids, and
the runs hashed in a stream, so that a class of any number of copies passes in bounded memory.

Defined results: rows without a conv_id belong to no conversation; null turns come first, turns of one number stand in the order of
role and text (equal rows are turns of their own); null roles and texts are empty; an empty table has no nodes; extra columns never
enter. Depths cost a few Spark jobs each: two different conversations that agree in thousands of turns cost as many rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, ranked, stored, text_of

#: Turns that a conversation takes from another, at most, in ``rebuilt``; and turns of a class that are held at once, for so many depths.
SHARED, BLOCK = 8, 8
#: Ids that are joined to one string before they are hashed.
RUN = 4096
NOBODY = hashlib.sha256(b"").hexdigest()
TURN = "array<struct<place:bigint,digest:binary,bytes:bigint,before:bigint>>"


def turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, digest, bytes, place, before): each turn with its place from 0 and the bytes of text before it."""
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return ranked(rows, "conv_id", order, ["conv_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes")], "trie-turns", weight="bytes")


def _sizes(own: DataFrame, heads: bool) -> DataFrame:
    """(conv_id, len, total, heads): turns and bytes of each conversation, and its first turns."""
    first = F.when(F.col("place") < SHARED, F.struct("place", "digest", "bytes", "before"))
    more = [F.sort_array(F.collect_list(first)).alias("heads")] if heads else []
    return own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"), F.sum("bytes").alias("total"), *more)


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, digest, bytes, before) and sizes (conv_id, size, total) when conversations share their beginnings.

    Conversation c begins with the first h turns of conversation c - c % 5 (all if fewer, none if it is absent) and goes on with its own after
    its first h, for h the CRC-32 of c modulo 9. ``own`` are ``turns``. A conversation gives to at most 8 others: no key is hot there.
    """
    convs = stored(_sizes(own, True), "trie-sizes")
    donors = convs.select(F.col("conv_id").alias("donor"), F.col("len").alias("given"), F.col("heads").alias("lent"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(SHARED + 1)).cast("int")
    asked = convs.withColumns({"h": h, "donor": F.col("conv_id") - F.col("conv_id") % 5}).join(donors, "donor", "left")
    shared = F.least(F.col("h"), F.coalesce("given", F.lit(0)).cast("int"))
    bytes_of = lambda turns: F.aggregate(turns, F.lit(0).cast("long"), lambda a, t: a + t["bytes"])
    asked = asked.withColumns({"first": F.coalesce(F.slice("lent", F.lit(1), shared), F.array().cast(TURN)), "skipped": bytes_of(F.slice("heads", F.lit(1), F.col("h"))), "shared": shared})
    asked = asked.withColumns({"shift": F.col("shared") - F.col("h"), "moved": bytes_of(F.col("first")) - F.col("skipped")})
    asked = stored(asked.select("conv_id", "h", "len", "shift", "moved", "first", (F.col("shared") + F.greatest(F.lit(0), F.col("len") - F.col("h"))).alias("size"), (F.col("total") + F.col("moved")).alias("total")), "trie-plan")
    kept = joined(own, asked.select("conv_id", "h", "len", "shift", "moved"), ["conv_id"], "len").filter("place >= h")
    kept = kept.select("conv_id", (F.col("place") + 1 + F.col("shift")).alias("depth"), "digest", "bytes", (F.col("before") + F.col("moved")).alias("before"))
    taken = asked.select("conv_id", F.explode("first").alias("t")).select("conv_id", (F.col("t.place") + 1).alias("depth"), "t.digest", "t.bytes", "t.before")
    return stored(kept.unionByName(taken), "trie-rebuilt"), asked.select("conv_id", "size", "total")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conversations as runs of one class: (size, x, y, total, conv_id, n, ids), at most ``RUN`` ids in each."""
    names, key, ids = ["size", "x", "y", "total", "conv_id", "n", "ids"], None, []
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
        out.clear()
        return made

    for rows in batches:
        for *own, conv in zip(*(rows.column(i).to_pylist() for i in range(5))):
            if ids and (own != key or len(ids) == RUN):
                out.append((*key, ids[0], len(ids), ",".join(map(str, ids))))
                ids = []
            key = own
            ids.append(conv)
        if len(out) >= RUN or sum(r[5] for r in out) >= RUN * 16:
            yield batch()
    if ids:
        out.append((*key, ids[0], len(ids), ",".join(map(str, ids))))
    if out:
        yield batch()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs as classes: (conv_id, n, size, total, ends)."""
    names, key, state, first, n = ["conv_id", "n", "size", "total", "ends"], None, None, None, 0
    for rows in batches:
        out = []
        for *own, conv, count, ids in zip(*(rows.column(i).to_pylist() for i in range(7))):
            if own != key:
                if key:
                    out.append((first, n, key[0], key[3], state.hexdigest()))
                key, state, first, n = own, hashlib.sha256(), conv, 0
            else:
                state.update(b",")
            state.update(ids.encode())
            n += count
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (first, n, key[0], key[3], state.hexdigest())], names=names)


def classes(steps: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, n, size, total, ends): conversations that are equal as a whole, by their smallest id, how many, and the hash of their ids."""
    parts = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = steps.groupBy("conv_id").agg(F.bit_xor(F.xxhash64("depth", "digest")).alias("x"), F.bit_xor(F.xxhash64("digest", "depth")).alias("y"))
    whole = stored(sizes.join(marks, "conv_id", "left").select(F.col("size").cast("long"), zero("x"), zero("y"), "total", "conv_id"), "trie-conversations")
    order = ["size", "x", "y", "total"]
    runs = whole.repartitionByRange(parts, *order, "conv_id").sortWithinPartitions(*order, "conv_id").mapInArrow(_runs, "size long, x long, y long, total long, conv_id long, n long, ids string")
    return stored(runs.repartition(parts, "x", "y").sortWithinPartitions(*order, "conv_id").mapInArrow(_hashed, "conv_id long, n long, size long, total long, ends string"), "trie-classes")


def _levels(steps: DataFrame, kinds: DataFrame, root: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Down: of each depth from 1 its groups (node: the parent, child, n_convs, classes, ...), and of each from 0 the classes that end in nodes of several (node, conv_id)."""
    live = kinds.select("conv_id", "n", "size", "total", F.lit(root).cast("long").alias("node"), F.lit(0).cast("long").alias("above"))
    groups, ended, depth = [], [], 0
    while True:
        ended.append(live.filter(F.col("size") == depth).select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id"))
        live = live.filter(F.col("size") > depth)
        if depth % BLOCK == 0:
            ahead = steps.filter((F.col("depth") > depth) & (F.col("depth") <= depth + BLOCK))  # at most BLOCK rows of a class
            ahead = ahead.join(live.select("conv_id"), "conv_id").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "bytes"))).alias("ahead"))
            live = stored(live.drop("ahead").join(ahead, "conv_id"), "trie-ahead")
        turn = F.col("ahead")[depth % BLOCK]
        step = live.withColumns({"digest": turn["digest"], "bytes": turn["bytes"]})
        level = step.groupBy("node", "digest").agg(F.min("conv_id").alias("child"), F.sum("n").alias("n_convs"), F.count(F.lit(1)).alias("classes"), F.max("bytes").alias("bytes"), F.max("above").alias("above"), F.max("size").alias("size"), F.max("total").alias("total"))
        groups.append(stored(level, "trie-level"))
        several = groups[-1].filter("classes > 1")
        if several.isEmpty():
            return groups, ended
        further = joined(step, several.select("node", "digest", "child", "classes"), ["node", "digest"], "classes")
        live = stored(further.select("conv_id", "n", "size", "total", F.col("child").alias("node"), (F.col("above") + F.col("bytes")).alias("above"), "ahead"), "trie-live")
        depth += 1


def build(steps: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations ``sizes(conv_id, size, total)`` with turns ``steps(conv_id, depth, digest, bytes, before)``.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); saved are bytes of text.
    """
    kinds = classes(steps, sizes)
    whole = kinds.agg(F.min("conv_id"), F.sum("n")).first()  # two numbers
    if whole[0] is None:
        return _nodes(kinds.limit(0).withColumns({"depth": F.lit(0), "parent": F.lit(None), "n_children": F.lit(0), "leaves": F.lit(0), "saved": F.lit(0)}))
    groups, ended = _levels(steps, kinds, whole[0])
    saved = (F.col("n_convs") - 1) * (F.col("total") - F.col("above"))
    nodes, below = [], None
    for depth in range(len(groups), 0, -1):  # up: of nodes of several classes at this depth, then what they add to those above
        level = groups[depth - 1]
        added = level.filter("classes = 1").select("node", F.lit(1).cast("long").alias("leaves"), saved.alias("saved"))
        inner = level.filter("classes > 1")
        if below is not None:
            sums = inner.join(below, inner["child"] == below["parent"]).select("child", "node", "n_convs", "n_children", "leaves", (F.col("saved") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
            sums = stored(sums, "trie-nodes")
            nodes.append(sums.select(F.col("child").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("node").alias("parent"), F.col("n_convs").alias("n"), "n_children", "leaves", "saved"))
            added = added.unionByName(sums.select("node", "leaves", "saved"))
        below = added.groupBy(F.col("node").alias("parent")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    base = kinds.sparkSession.createDataFrame([(whole[0], whole[1])], "conv_id long, n long")  # the root, one row
    nodes.append(base.join(below, F.col("conv_id") == F.col("parent"), "left").select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), "n", zero("n_children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("leaves"), zero("saved")))
    top = nodes[0]
    for more in nodes[1:]:
        top = top.unionByName(more)
    stops = ended[0]
    for more in ended[1:]:
        stops = stops.unionByName(more)
    stops = stops.join(kinds.select("conv_id", "ends"), "conv_id").select(F.col("node").alias("conv_id"), "depth", "ends")
    heads = None
    for depth, level in enumerate(groups, 1):
        own = level.filter("classes = 1").select(F.col("child").alias("conv_id"), F.lit(depth).cast("long").alias("head"), "node", F.col("n_convs").alias("n"), "size", "total")
        heads = own if heads is None else heads.unionByName(own)
    heads = stored(heads.join(kinds.select("conv_id", "ends"), "conv_id"), "trie-chains")
    chain = joined(steps, heads, ["conv_id"], "size").filter("depth >= head")
    last = F.col("depth") == F.col("size")
    chain = chain.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("head"), F.col("node")).otherwise(F.col("conv_id")).alias("parent"), "n", F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("leaves"), ((F.col("n") - 1) * (F.col("total") - F.col("before"))).alias("saved"), F.when(last, F.col("ends")).alias("ends"),
    )
    return _nodes(top.join(stops, ["conv_id", "depth"], "left").unionByName(chain))


def zero(name: str) -> Column:
    return F.coalesce(name, F.lit(0).cast("long")).alias(name)


def _nodes(rows: DataFrame) -> DataFrame:
    longs = {"conv_id": "conv_id", "depth": "depth", "parent_conv_id": "parent", "n_convs": "n", "n_children": "n_children", "n_leaves": "leaves", "saved_tokens": "saved"}
    return rows.select(*[F.col(c).cast("long").alias(k) for k, c in longs.items()], F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"))


def prefix_trie(df: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    own = turns(df)
    sizes = _sizes(own, False)
    return build(own.select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "bytes", "before"), sizes.select("conv_id", F.col("len").alias("size"), "total"))


def shared_prefix_trie(df: DataFrame) -> DataFrame:
    """The trie of conversations ``rebuilt`` to share their beginnings."""
    return build(*rebuilt(turns(df)))
