"""Token ids in binary segments of patched frame-of-reference blocks.

A block of ids stores its minimum, then each id less that minimum in a width that a percentile of the block's values
fits; wider values are *exceptions*: their low bits stand in place and their place and high bits in a list behind. An
index holds the start of each block, so that any range of ids is read without the blocks before it.

Segment: magic, counts, doc ids, doc lengths, block index, blocks; all little-endian. Segments are rows of a Parquet
table (``part``, ``segment``, first position in the part, body), so that Spark's committer makes retries safe on any
store. Texts are dealt by range of doc_id, so that parts and segments are in ascending order; a document's global start
is its place in its part plus the ids of the parts before, a sum over one number a part.

Defined results: a null text is the empty text and has the end id alone; null keys come first; rows that repeat a key
stand together in the order of their texts; an empty table gives empty files; extra columns never enter.
"""

from __future__ import annotations

import gc
import os
import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_path, slices, text_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
MAGIC = b"PFB1"
BLOCK = 256
PERCENTILE = 90
#: Ids after which a segment is closed, and words of a generation, of which a worker keeps the ids of two.
SEGMENT_IDS, CACHED_WORDS = 1 << 19, 450_000
#: Bytes of text encoded at once: the more, the fewer different words are looked up.
BATCH_BYTES = 5 << 20
#: A blank beside white space, in RE2's syntax.
BLANKS = r" [\s\x0b\x1c-\x1f\x{85}\pZ]|[\s\x0b\x1c-\x1f\x{85}\pZ] "
SEGMENT = "part int, segment int, first long, n_ids long, body binary"


def pack(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """The starts of the blocks of ``ids`` (uint32) within the second value, and their bytes."""
    n = len(ids)
    if not n:
        return np.zeros(1, np.uint64), b""
    rows = np.resize(ids, -(-n // block) * block)
    rows[n:] = ids[-1]
    rows = rows.reshape(-1, block)
    low = rows.min(1)
    rest = rows - low[:, None]
    at = np.partition(rest, block * percentile // 100 - 1, axis=1)[:, block * percentile // 100 - 1]
    width = np.frexp(at.astype(np.float64))[1].astype(np.int64)
    wide = rest >> np.minimum(width, 31)[:, None].astype(np.uint32)
    wide[width == 32] = 0
    counts = np.count_nonzero(wide, axis=1)
    heads = np.zeros(len(rows), [("low", "<u4"), ("width", "u1"), ("n", "<u2")])
    heads["low"], heads["width"], heads["n"] = low, width, counts
    places = np.nonzero(wide)
    exceptions = np.zeros(len(places[0]), [("at", "<u2"), ("high", "<u4")])
    exceptions["at"], exceptions["high"] = places[1], wide[places]
    patch, ends = exceptions.tobytes(), np.cumsum(counts).tolist()
    packed: list[bytes] = [b""] * len(rows)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        unit = 2 if w <= 16 else 4  # exceptions lose their high bits here
        bits = np.unpackbits(rest[own].astype(f">u{unit}").view(np.uint8).reshape(len(own), block, unit), axis=2)[:, :, 8 * unit - w :]
        data = np.packbits(bits.reshape(len(own), -1), axis=1)
        for i, b in zip(own.tolist(), data):
            packed[i] = b.tobytes()
    head, one, each = heads.tobytes(), heads.itemsize, exceptions.itemsize
    out = [head[one * i : one * (i + 1)] + packed[i] + patch[each * (ends[i - 1] if i else 0) : each * ends[i]] for i in range(len(rows))]
    return np.cumsum([0, *map(len, out)]).astype(np.uint64), b"".join(out)


def unpack(starts: np.ndarray, data: bytes, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of the blocks that begin at ``starts`` in ``data``."""
    blocks = len(starts) - 1
    raw, start = np.frombuffer(data, np.uint8), starts[:-1].astype(np.int64)
    if not blocks:
        return np.zeros(0, np.uint32)
    head = raw[start[:, None] + np.arange(7)]
    low, width, counts = head[:, :4].copy().view("<u4")[:, 0], head[:, 4].astype(np.int64), head[:, 5:7].copy().view("<u2")[:, 0].astype(np.int64)
    out = np.zeros((blocks, block), np.uint32)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        bits = np.unpackbits(raw[start[own, None] + 7 + np.arange(w * block // 8)], axis=1).reshape(len(own), block, w)
        unit = 2 if w <= 16 else 4
        full = np.zeros((len(own), block, 8 * unit), np.uint8)
        full[:, :, 8 * unit - w :] = bits
        out[own] = np.packbits(full, axis=2).view(f">u{unit}")[:, :, 0]
    total = int(counts.sum())
    if total:
        row = np.repeat(np.arange(blocks), counts)
        nth = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        at = raw[(start[row] + 7 + width[row] * block // 8 + 6 * nth)[:, None] + np.arange(6)]
        place, high = at[:, :2].copy().view("<u2")[:, 0], at[:, 2:].copy().view("<u4")[:, 0]
        out[row, place] |= high << width[row].astype(np.uint32)
    return (out + low[:, None]).reshape(-1)[:n]


def segment(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A segment of the ids of documents, ``lengths`` of each."""
    starts, data = pack(ids)
    nulls = np.packbits([k is None for k in keys]).tobytes()
    return b"".join((MAGIC, struct.pack("<IQI", len(keys), len(ids), BLOCK), np.array([k or 0 for k in keys], "<i8").tobytes(), nulls, lengths.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), data))


def opened(body: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Keys, lengths and all ids of a segment."""
    if body[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, n, block = struct.unpack_from("<IQI", body, 4)
    at = 20
    keys = np.frombuffer(body, "<i8", docs, at)
    at += 8 * docs
    nulls = np.unpackbits(np.frombuffer(body, np.uint8, -(-docs // 8), at), count=docs)
    at += -(-docs // 8)
    lengths = np.frombuffer(body, "<u8", docs, at)
    at += 8 * docs
    blocks = -(-n // block)
    starts = np.frombuffer(body, "<u8", blocks + 1, at)
    return [None if x else k for k, x in zip(keys.tolist(), nulls.tolist())], lengths, unpack(starts, body[at + 8 * (blocks + 1) :], n, block)


class LibraryEncoder(dict):
    """Ids of texts by the tokenizers library, with those of recurring words kept.

    A blank between two characters that are no white space always begins a new word for a byte-level tokenizer, so that a
    text may be cut there and each word encoded on its own, with its blank. Texts where blanks meet other white space, or
    with special tokens, are encoded as a whole. Arrow cuts a batch of texts and finds its different words; these are looked
    up here (as a dictionary, this maps words behind a blank to the bytes of their ids), and numpy gathers the ids.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # byte-level models write a byte that is no printable character as the next free one from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.raw = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.blank, self.tails, self.old = self.shown[32], {}, {}
        self.tokenize, self.pre_tokens = self.model.tokenize, regex.compile(public_tokenizers.PATTERN).findall

    def __missing__(self, word: str) -> bytes:
        """A new word of Latin letters, with marks behind it or not, goes to the library's model in its pre-tokens; any other goes through the whole library."""
        out = self.old.get(word)
        if out is None:
            body = word.rstrip(string.punctuation)
            if not body.isalpha():
                out = self.other(word)
            elif len(body) < len(word):
                out = (self.get(body) or self.letters(body)) + self.tail(word[len(body) :])
            else:
                out = self.letters(word)
        if len(word) <= 64:
            self[word] = out
        return out

    def letters(self, word: str) -> bytes:
        """The ids of a word of letters, with a blank before it."""
        if word.isascii():
            shown = self.blank + word
        elif max(word) < "\u0250":
            shown = self.blank + word.encode().decode("latin-1").translate(self.shown)
        else:
            return self.batch([f" {word}"])[0]
        return b"".join([self.raw[t.id] for t in self.tokenize(shown)])

    def tail(self, marks: str) -> bytes:
        """The ids of ASCII marks that stand behind a word."""
        if marks not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[marks] = b"".join([self.raw[t.id] for t in self.tokenize(marks)])
        return self.tails[marks]

    def other(self, word: str) -> bytes:
        """The ids of a word that is more than letters, with a blank before it."""
        if not word or max(word) >= "\u0250":
            return self.batch([f" {word}"])[0]
        parts = (p.encode().decode("latin-1").translate(self.shown) for p in self.pre_tokens(f" {word}"))
        return b"".join([self.raw[t.id] for p in parts for t in self.tokenize(p)])

    def batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.StringArray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by ``end_id`` if there is one, and their number for each text."""
        if len(self) > CACHED_WORDS:  # words of the last generation move up when they are met again
            self.old = dict(self)
            self.clear()
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        whole = pc.match_substring_regex(texts, BLANKS)
        for token in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        cut = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        offsets, words = offsets - offsets[0], cut.flatten()
        firsts = [t if w else f for t, w, f in zip(texts.to_pylist(), whole.to_pylist(), words.take(pa.array(offsets[:-1])).to_pylist())] if pc.any(whole).as_py() else words.take(pa.array(offsets[:-1])).to_pylist()
        coded = words.dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        # the first word of each text has no blank before it: it has an entry of its own, as the end has
        entries = [*map(self.__getitem__, known), *self.batch(firsts), np.array([] if end_id is None else [end_id], "<u4").tobytes()]
        codes = coded.indices.to_numpy().astype(np.int32)
        codes[offsets[:-1]] = len(known) + np.arange(n)
        codes = np.insert(codes, offsets[1:], np.int32(len(entries) - 1))
        offsets = offsets + np.arange(n + 1)
        size = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
        begin = np.cumsum(size) - size
        sizes = size[codes]
        at = np.cumsum(sizes)
        ids = np.frombuffer(b"".join(entries), "<u4")[np.repeat(begin[codes] - at + sizes, sizes) + np.arange(at[-1])]
        return ids, np.diff(np.concatenate(([0], at))[offsets])


@lru_cache(maxsize=1)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """The ids of each text and ``end_id``, in ascending order of ``key``, as segments below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(vocabulary), TaskContext.get().partitionId()
        gc.disable()  # nothing here is cyclic, and the words kept are many objects to look through
        number = first = size = 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            keys, ids, lengths = zip(*held)
            body = segment([k for part in keys for k in part], np.concatenate(lengths), np.concatenate(ids))
            row = zip(([part], [number], [first], [size], [body]), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in row], names=["part", "segment", "first", "n_ids", "body"])

        try:
            for batch in slices(batches, limit=BATCH_BYTES):
                held.append((batch.column(0).to_pylist(), *own.encode(batch.column(1), end_id)))
                size += len(held[-1][1])
                if size >= SEGMENT_IDS:
                    yield close()
                    number, first, size, held = number + 1, first + size, 0, []
            if held:
                yield close()
        finally:  # a worker is used again, also after a task that failed or was stopped
            gc.enable()

    rows = df.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SEGMENT).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of the segments below ``path``, from their decoded blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, lengths, ids = opened(body.as_buffer())
                ends = np.cumsum(lengths.astype(np.int64))
                raw, bounds = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
                sums = [zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
                cols = [pa.array(keys, pa.int64()), pa.array(first + ends - lengths.astype(np.int64)), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.schema(SEGMENT).parquet(path)
    before = F.sum("n").over(W.orderBy("part")) - F.col("n")
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before.alias("before"))
    # one row a part, of which there are as many as shuffle partitions
    placed = files.join(F.broadcast(parts), "part").select((F.col("first") + F.col("before")).alias("first"), "body")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """The ids of ``df`` written and read back, as ``read`` returns them."""
    path = shared_path(df.sparkSession, "token-ids")
    write(df, path, text, key, vocabulary)
    return read(df.sparkSession, path)
