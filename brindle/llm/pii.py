"""Personal data: base patterns, and bootstrapped contextual extraction of further identifiers.

Base spans are seeds. The two words before the word that an occurrence begins in are its lexical *pattern*, the token its
*instance*. Patterns, instances and their counts form a bipartite graph, which Spark scores in rounds: a pattern is as
reliable as the share of all its occurrences in the corpus that reliable instances follow; an instance that no seed
vouches for is as reliable as its best pattern. Beliefs are whole hundredths that only rise, and rounds go on until none
changes. Tokens with digits, of any length, that follow a reliable pattern of enough different instances become further
spans of kind ``id``. Counting *all* occurrences of a pattern, also before ordinary words, keeps "of the" out.

Texts are read twice in narrow passes: for spans and candidates, and to count pattern occurrences. The second gets the
supported patterns as a bitmap of fixed size; what passes it by chance falls out in the join. Everything else works on
candidates, a small part of the text, with sums that combine on the map side.

Defined results: a null text is the empty text (no spans, the hash of nothing); an empty table gives an empty result;
repeated rows come out each and count each as evidence; extra columns never enter.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_of

KINDS = ("email", "ip", "card", "phone")
EXTRA = "id"
#: Different instances that a pattern needs, and the reliability that it and they need, in hundredths.
SUPPORT, RELIABLE, SURE = 3, 50, 100
#: Slots of the bitmap of supported patterns; counts a task holds at once.
SLOTS, HELD = 1 << 20, 100_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# a match always begins with a run of digits, so that runs without the rest of an address are stepped over whole
_IP = re.compile(r"([0-9]++)(?:(\.[0-9]++)(\.[0-9]++)(\.[0-9]++))?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_REST = re.compile(r"\S*+")
_ZEROED = str.maketrans("123456789", "0" * 9)
_EDGE = ".,;:!?()[]{}<>\"'`*#%&$|"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and then kind; code points, end exclusive."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # the local part is the whole run before an @, as far as the last address leaves it free
        if at > free and _LOCAL.match(text, at - 1) and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > free and _LOCAL.match(text, start - 1):
                start -= 1
            out.append((start, 0, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if m[2] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in (m[1], m[2][1:], m[3][1:], m[4][1:])):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def context(text: str, start: int) -> str:
    """The pattern of the word that begins at ``start``: the two words before, in lower case with digits as 0; ^ where there are fewer."""
    size = 32
    while True:
        words = text[max(0, start - size) : start].split()
        if size >= start or len(words) > 2:  # the first of three may be cut
            break
        size *= 4
    words = words[-2:]
    return " ".join(["^"] * (2 - len(words)) + words).lower().translate(_ZEROED)


class _Words:
    """The word around a place and its pattern; places are asked for in ascending order, so that each word is looked at once."""

    def __init__(self, text: str):
        self.text, self.start, self.end, self.pattern = text, 0, 0, ""

    def around(self, at: int) -> "_Words":
        if at >= self.end:
            start = at
            while start > self.end and not self.text[start - 1].isspace():
                start -= 1
            self.start, self.end, self.pattern = start, _REST.match(self.text, at).end(), context(self.text, start)
        return self


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str, str, bool]]:
    """(start, end, pattern, instance, seed): the base spans, and tokens with a digit that overlap none of them."""
    word = _Words(text)
    out = [(a, b, word.around(a).pattern, f"{KINDS[k]}:{text[a:b].lower()}", True) for a, k, b in spans]
    taken, i = sorted((a, b) for a, _, b in spans), 0
    word = _Words(text)
    while m := _DIGIT.search(text, word.end):
        word.around(m.start())
        token = text[word.start : word.end]
        a = word.start + len(token) - len(token.lstrip(_EDGE))
        b = a + len(token.strip(_EDGE))
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if not any(x < b for x, _ in taken[i : i + 1]):
            out.append((a, b, word.pattern, f"{EXTRA}:{text[a:b].lower()}", False))
    return out


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<start:long,stop:long,pattern:string,instance:string,seed:boolean>>"
_FOUND_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("pattern", pa.string()), ("instance", pa.string()), ("seed", pa.bool_())]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [_FOUND_TYPE]
    for part in slices(batches):
        rows = []
        for text in part.column(1).to_pylist():
            spans = base_spans(text)
            n = [0] * 4
            for _, k, _ in spans:
                n[k] += 1
            base = listed(spans)
            rows.append((*n, hashlib.sha256(base.encode()).hexdigest(), base, [dict(zip(("start", "stop", "pattern", "instance", "seed"), c)) for c in candidates(text, spans)]))
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"])


def occurrences(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each of ``patterns(pattern)`` stands before a word in the texts of ``texts(text)``."""
    slot = F.crc32(F.col("pattern").cast("binary")) % SLOTS
    rows = patterns.select(slot.alias("s")).groupBy(F.expr("bitmap_bucket_number(s + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s + 1))").alias("bits"))
    bits = bytearray(SLOTS // 8)
    for bucket, data in rows.collect():  # at most SLOTS / 32768 rows of 4096 bytes; Spark counts from 1: s + 1 is bit s, bucket b begins at slot 32768 (b - 1)
        bits[4096 * (bucket - 1) : 4096 * bucket] = data
    bitmap = bytes(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def held() -> pa.RecordBatch:
            cols = [pa.array([k.decode() for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["pattern", "total"])

        crc = zlib.crc32
        for part in slices(batches, 0):
            for text in part.column(0).to_pylist():
                words = " ".join(["^", "^", *text.lower().translate(_ZEROED).split()]).encode().split(b" ")
                pairs = list(map(b"%b %b".__mod__, zip(words[:-2], words[1:-1])))
                seen.update([p for p, h in zip(pairs, map(crc, pairs)) if bitmap[h % SLOTS >> 3] >> (h & 7) & 1])
            if len(seen) > HELD:
                yield held()
                seen.clear()
        yield held()

    counted = texts.mapInArrow(run, "pattern string, total long").groupBy("pattern").agg(F.sum("total").alias("total"))
    return counted.join(patterns, "pattern", "left_semi")


def reliable_patterns(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, reliability in hundredths): patterns that discover, from candidates (pattern, instance, seed) and the texts they are from."""
    edges = found.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    edges = stored(edges, "pii-edges")
    wide = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"), F.sum("n").alias("own")).filter(F.col("instances") >= SUPPORT)
    wide = stored(wide, "pii-patterns")
    totals = occurrences(texts, wide.select("pattern"))
    # a word that holds several base spans counts as often
    wide = wide.join(totals, "pattern", "left").select("pattern", F.greatest("own", F.coalesce("total", F.lit(0))).alias("total"))
    edges = stored(edges.join(wide, "pattern"), "pii-graph")
    # an instance is known by its name, which begins with its kind: every edge of one is a seed's, or none
    believed, state = edges.filter("seed").select("instance", F.lit(SURE).cast("long").alias("belief")).distinct(), None
    while True:
        scored = edges.join(believed, "instance").groupBy("pattern").agg(F.floor(F.sum(F.col("n") * F.col("belief")) / F.first("total")).alias("reliability"), F.count_if(F.col("belief") >= RELIABLE).alias("instances"))
        patterns = stored(scored.filter(F.col("instances") >= SUPPORT).select("pattern", "reliability"), "pii-scores")
        best = edges.filter("not seed").join(patterns, "pattern").groupBy("instance").agg(F.max("reliability").alias("belief"))
        seeds = edges.filter("seed").select("instance", F.lit(SURE).cast("long").alias("belief")).distinct()
        believed = stored(seeds.unionByName(best.filter("belief > 0")), "pii-beliefs")
        now = tuple(believed.agg(F.count(F.lit(1)), F.sum("belief")).first())
        if now == state:
            return patterns.filter(F.col("reliability") >= RELIABLE)
        state = now


def extract(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id) of each text; spans are kind:start:end by start and kind."""
    texts = df.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = stored(texts.mapInArrow(_found, FOUND).withColumn("row", F.monotonically_increasing_id()), "pii-found")
    found = rows.select("row", F.inline("found"))
    patterns = reliable_patterns(found.select("pattern", "instance", "seed"), texts.select("text"))
    new = found.filter("not seed").join(patterns, "pattern").groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("new"))
    base = F.transform(F.filter(F.split("spans", ","), lambda s: s != ""), lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(2)).cast("long").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.split_part(s, F.lit(":"), F.lit(1))).alias("kind"), s.alias("span")))
    more = F.transform("new", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS) + 1).cast("long").alias("kind"), F.concat_ws(":", F.lit(EXTRA), s["start"], s["stop"]).alias("span")))
    every = F.array_join(F.transform(F.array_sort(F.concat(base, more)), lambda s: s["span"]), ",")
    out = rows.drop("found").join(new, "row", "left")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.when(F.col("new").isNull(), F.col("spans")).otherwise(every).alias("spans"), F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("n_id"))
