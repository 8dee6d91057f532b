"""Byte-level BPE encoding and decoding.

A word's symbols form a doubly linked list. A priority queue holds the merge rank and place of each adjacent pair; the
least is applied, its neighbours are queued anew, and entries whose pair has changed since are skipped when they come up.
That is O(n log n) in the length of a word, so that a text without blanks is no trouble. Words recur, so each worker
keeps the ids of words in a bounded cache. Decoding concatenates the vocabulary's byte strings.

Each row is encoded on its own in one narrow pass: no shuffle, no state between rows but the cache.

Defined results: a null text is the empty text, with no ids; an empty table gives an empty result; repeated rows come
out each; special tokens in a text are matched as the vocabulary file says; extra columns never enter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_of

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Words whose ids a worker keeps; the cache starts anew when it is full.
CACHED_WORDS = 400_000


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec(dict):
    """Encoder and decoder of one vocabulary file. As a dictionary, it maps words to their tuples of ids."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, byte_of = file["model"], byte_characters()
        if model["type"] != "BPE" or (file["pre_tokenizer"] or {}).get("type") != "ByteLevel" or file["pre_tokenizer"].get("add_prefix_space") or file["normalizer"]:
            raise ValueError("only byte-level BPE without a normalizer is read")
        as_bytes = lambda token: bytes(byte_of[c] for c in token)
        vocab = model["vocab"]
        self.strings: list[bytes] = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in file["added_tokens"])]))
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        for token, i in vocab.items():
            if token not in self.specials:
                self.strings[i] = as_bytes(token)
        for token, i in self.specials.items():
            self.strings[i] = token.encode()
        self.byte_ids = [vocab[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.ranks = {vocab[a] << 20 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.decimal = [str(i) for i in range(len(self.strings))]
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self[word] = tuple(self.merged([self.byte_ids[b] for b in word.encode()]))
        return ids

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, least rank first and leftmost among equals."""
        rank_of, n = self.ranks.get, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r[0], i, symbols[i] << 20 | symbols[i + 1]) for i in range(n - 1) if (r := rank_of(symbols[i] << 20 | symbols[i + 1]))]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j >= n or symbols[i] << 20 | symbols[j] != pair:  # stale
                continue
            symbols[i], symbols[j] = rank_of(pair)[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := rank_of(symbols[i] << 20 | symbols[k]):
                    heapq.heappush(queue, (r[0], i, symbols[i] << 20 | symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank_of(symbols[h] << 20 | symbols[i])):
                heapq.heappush(queue, (r[0], h, symbols[h] << 20 | symbols[i]))
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> list[int]:
        if self.special is None or not self.special.search(text):
            return list(chain.from_iterable(map(self.__getitem__, self.words(text))))
        ids: list[int] = []
        for part in self.special.split(text):
            ids += [self.specials[part]] if part in self.specials else chain.from_iterable(map(self.__getitem__, self.words(part)))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The codec of a vocabulary file, one for each worker."""
    return Codec(path)


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the token ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for part in slices(batches):
            ids = pa.array([own.encode(t) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return df.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(df: DataFrame, ids: str = "ids", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text): the text of each list of ids; a null list is the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [own.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again, as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for part in slices(batches):
            rows = []
            for t in part.column(1).to_pylist():
                ids = own.encode(t)
                listed = ",".join(map(own.decimal.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
