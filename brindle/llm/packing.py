"""Packing documents into sequences of at most ``CAPACITY`` tokens: best-fit decreasing, certified by lower bounds.

Texts are encoded where they are read; from there on a document is a row of numbers. A document longer than a sequence is cut
so that all of its pieces but the first are whole sequences; what remains, one item a document, is packed. Items are dealt evenly
to groups of about ``GROUP`` items. Dual feasible functions give lower bounds for any packing; the one that bounds all items best is
found from a histogram of their lengths, which has at most ``CAPACITY`` rows. A group packs its own by best fit, larger items first, and
certifies the number of its sequences by that function: a group that meets its bound can't be packed better and is settled, also as
a part of the whole. Groups with a *gap* give the documents of sequences that have room, and of half of the full ones, to the next
round, in which they are dealt anew with those of other such groups and packed again; an exchange never makes more sequences, since a
group keeps what it was given where the new packing isn't better. Rounds end at the lower bound of all items, or when exchanges gain
nothing more. Bounds are whole numbers: when no gap is left and yet a sequence too many, rounds go on with all that have room.

Defined results: a null text is the empty text and is its end id alone; rows without a doc_id or with equal ones are packed each on
its own; an empty table gives an empty result; extra columns never enter. Numbers of sequences are any, and differ by run.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_of
from .tokenbin import BATCH_BYTES, END_ID, VOCABULARY, encoder

CAPACITY = 1024
#: Items of a group, about, and how many times as many of a group that exchanges; exchanges at most, and how many of them may gain nothing before they end.
GROUP, WIDER, ROUNDS, PATIENCE = 1 << 14, 4, 8, 1
PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): the encoded documents, cut; row is another for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = encoder(vocabulary), TaskContext.get().partitionId() << 40
        gc.disable()  # nothing here is cyclic, and the words kept are many objects to look through
        try:
            for batch in slices(batches, limit=BATCH_BYTES):
                ids, counts = own.encode(batch.column(1), end_id)
                n = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                end = counts[doc] - (n[doc] - 1 - piece) * capacity
                start = np.maximum(0, end - capacity)
                length = end - np.where(piece == 0, 0, start)
                start[piece == 0] = 0
                raw, first = ids.astype("<u4").tobytes(), (np.cumsum(counts) - counts)[doc] + start
                sums = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), length.tolist())]
                cols = [pa.array(row + np.arange(len(doc))), batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "piece", "start", "length", "ids_crc32"])
                row += len(doc)
        finally:  # a worker is used again, also after a task that failed or was stopped
            gc.enable()

    return df.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, PIECE)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item when larger ones go first, each into the fullest bin that has room for it.

    Items of one length go together: the fullest bin with room stays that until it has none, so that bins of equal room are filled as one.
    """
    bins = np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    sizes, first = np.unique(-lengths[order], return_index=True)
    room: list[list[np.ndarray]] = [[] for _ in range(capacity + 1)]
    some, made = np.zeros(capacity + 1, bool), 0
    for size, items in zip((-sizes).tolist(), np.split(order, first[1:])):
        while len(items):
            least = size + int(np.argmax(some[size:]))
            if some[least]:
                own = np.concatenate(room[least])
                room[least], some[least] = [], False
            else:
                least = capacity
                own = made + np.arange(-(-len(items) // (capacity // size)))
                made += len(own)
            each = least // size
            now = min(len(items), each * len(own))
            full, rest = divmod(now, each)
            bins[items[:now]] = np.concatenate((np.repeat(own[:full], each), np.repeat(own[full : full + 1], rest)))
            items = items[now:]
            for left, part in ((least - each * size, own[:full]), (least - rest * size, own[full : full + 1] if rest else own[:0]), (least, own[full + (rest > 0) :])):
                if len(part) and left:
                    room[left].append(part)
                    some[left] = True
    return bins


def certificate(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The dual feasible function that bounds best the bins of ``counts[x]`` items of each length x: its values and that of a whole bin.

    Such a function maps lengths so that what fits into a bin, fits still; then the sum over all items bounds the bins of any packing.
    Three families: thresholds (long items count whole, short ones not at all), parts of a threshold, and multiples rounded down.
    """
    x, n = np.arange(capacity + 1, dtype=np.int64), counts.astype(np.int64)
    best, most = (x, capacity), -1
    for t in range(1, capacity // 2 + 1):
        parts = capacity // t
        for f, whole in ((np.where(x > capacity - t, capacity, np.where(x < t, 0, x)), capacity), (np.where(2 * x > capacity, parts - (capacity - x) // t, np.where(x >= t, 1, 0)), parts)):
            if (bound := bins_of(f, whole, n)) > most:
                best, most = (f, whole), bound
    for k in range(1, 100):
        f = np.where((k + 1) * x % capacity == 0, k * x, (k + 1) * x // capacity * capacity)
        if (bound := bins_of(f, k * capacity, n)) > most:
            best, most = (f, k * capacity), bound
    return best


def bins_of(f: np.ndarray, whole: int, counts: np.ndarray) -> int:
    """The bins that a dual feasible function asks for."""
    return -(-int((f * counts).sum()) // whole)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing of ``counts[x]`` items of each length x has fewer bins."""
    return bins_of(*certificate(counts, capacity), counts)


def _packed(capacity: int, turn: int, f: np.ndarray, whole: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """A group with its bins anew: bin, offset in it, room left in it, whether the item is its first, and the group's gap."""

    def run(key: tuple, items: pa.Table) -> pa.Table:
        items = items.drop_columns(["group"])
        length, given = items.column("length").to_numpy(), items.column("bin").to_numpy()
        bins = best_fit_decreasing(length, capacity)
        if turn:
            old, before = np.unique(given, return_inverse=True)
            bins = before if len(old) <= bins.max() + 1 else bins
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(length[order])
        first = np.ones(len(order), bool)
        first[1:] = np.diff(bins[order]) > 0
        begin = (ends - length[order])[first]
        offset, heads = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
        offset[order] = ends - length[order] - begin[np.cumsum(first) - 1]
        heads[order] = first
        fill = np.bincount(bins, weights=length).astype(np.int64)
        gap = len(fill) - bins_of(f, whole, np.bincount(length, minlength=capacity + 1))
        made = {"bin": bins + ((turn << 54) | (key[0].as_py() << 24)), "offset": offset, "room": capacity - fill[bins], "head": heads.astype(np.int64), "gap": np.full(len(length), gap, np.int64)}
        for name, values in made.items():
            items = items.drop_columns([name]) if name in items.column_names else items
            items = items.append_column(name, pa.array(values))
        return items

    return run


def packed(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> tuple[DataFrame, list[tuple[int, int]]]:
    """``items`` (row and length, shorter than a bin, and more) with bin and offset; and of each round its bins and the lower bound of all items."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in items.groupBy("length").agg(F.count(F.lit(1))).collect():  # at most one row a length
        counts[length] = n
    f, whole = certificate(counts, capacity)
    bound, history, done, idle = bins_of(f, whole, counts), [], [], 0
    names = items.columns
    schema = ", ".join(f"{c} {t}" for c, t in items.dtypes) + ", bin long, offset long, room long, head long, gap long"
    free, n_free, settled = items.withColumn("bin", F.lit(-1).cast("long")), int(counts.sum()), 0
    for turn in range(ROUNDS + 1 if n_free else 0):
        groups = -(-n_free // (group * WIDER if turn else group))
        dealt = free.select(*names, "bin", F.pmod(F.xxhash64("bin" if turn else "row", F.lit(turn)), F.lit(groups)).alias("group"))
        out = stored(dealt.groupBy("group").applyInArrow(_packed(capacity, turn, f, whole), schema), "packing-round")
        bins, gaps = out.agg(F.sum("head"), F.count_if(F.col("gap") > 0)).first()
        history.append((settled + bins, bound))
        idle = idle + 1 if turn and history[-1][0] == history[-2][0] else 0
        done.append(out)
        if history[-1][0] == bound or idle > PATIENCE:
            break
        if gaps:
            coin = F.pmod(F.xxhash64("bin"), F.lit(2)) == 0  # half of the full ones go as well, lest the same items meet again
            leaves = (F.col("gap") > 0) & ((F.col("room") > 0) | coin)
            free, done[-1] = out.filter(leaves), out.filter(~leaves)
        else:  # nothing is left to gain within groups
            free, done = _union([d.filter("room > 0") for d in done]), [d.filter("room = 0") for d in done]
        n_free, n_bins = free.agg(F.count(F.lit(1)), F.coalesce(F.sum("head"), F.lit(0))).first()
        settled = history[-1][0] - n_bins
        if turn == ROUNDS or not n_free:
            done.append(free)
            break
    if not done:
        return items.select("*", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset")), history
    return _union(done).select(*names, "bin", "offset"), history


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def sequences(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY, group: int = GROUP) -> tuple[DataFrame, list[tuple[int, int]]]:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of ``df``; and the rounds of ``packed``."""
    cut = stored(pieces(df, text, key, vocabulary, end_id, capacity), "packing-pieces")
    rows, history = packed(cut.filter(F.col("length") < capacity), capacity, group)
    whole = cut.filter(F.col("length") == capacity).select("*", (-1 - F.col("row")).alias("bin"), F.lit(0).cast("long").alias("offset"))
    return rows.unionByName(whole).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"), history
