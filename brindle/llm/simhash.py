"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two segments of 32 bits. If two fingerprints differ in at most 3 bits, one segment differs in
at most one: every distinct fingerprint enters a table under both segments, probes each table with the Hamming ball of
radius 1 around its segment (33 keys), and verifies the complete distance of what it meets. Work is on *distinct*
fingerprints: exact copies collapse in a map-side aggregation first, so a group of copies costs one row.

A table entry that many fingerprints share (documents of one template) is cut again in the same way, by the balls of the
halves of what is left of them: 32 bits, then 16, until 8 bits are left, of which there are 256. So such a bucket never
pairs all its members.

Links become components by alternating large-star and small-star steps over tables; nothing is collected. The links of a
node are dealt to ``SALTS`` tasks, and groups that hold over a thousandth of all rows, which are fewer than a thousand, are
named by a broadcast.

``near_duplicates`` links 64-bit fingerprints of three words at 3 differing bits. ``keep_one`` looks further: texts whose sets
of five-word shingles are alike by a cosine of 0.8, which is what a share of differing bits estimates. That is a fifth of all
bits, so that the fingerprint is longer (``SEGMENTS`` segments of ``WIDTH`` bits) and the ball of a segment is directed: the
segment, and the segment with one of its ``LOOSE`` least certain bits turned. Both sides enter a table under their balls, meet
at up to two differing bits, and complete distances are verified. Distances estimate: a cosine of 0.8 passes nine times in ten,
one of 0.7 sometimes, one of 0.6 hardly ever. What meets under no segment is missed: recall is measured by a test. Members of
a table entry that many share meet two others, and then what is of another component: no group of copies pairs all its
members, and no pair that would join two groups is left out.

Defined results: a null text is the empty text, and texts without words have fingerprint zero and link like any other;
rows with a null key belong to the component of their fingerprint without naming it; repeated rows come out as often
as they came in; extra columns never enter. ``keep_one`` keeps exactly one row of each component: see there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import named, numbered, shared_path, slices, stored, text_of

SHINGLE = 3
SEED = 42
DISTANCE = 3
#: A table entry with more fingerprints than this is cut again.
LARGE_BUCKET = 64
#: Tasks that the links of one node are dealt to; a key is hot if it holds more than one of so many rows.
SALTS, HOT = 8, 1000
#: Shingles whose hash bits are held unpacked at once.
CHUNK = 1 << 15
#: The long fingerprint: words of a shingle, segments and their bits, least certain bits of a segment that a ball turns, and the cosine that counts as alike.
LONG_SHINGLE, SEGMENTS, WIDTH, LOOSE, SIMILARITY = 5, 16, 24, 8, 0.8
#: Standard deviations above the expected distance of that cosine that pass: so nine in ten of its pairs do.
SLACK = 1.28
#: Bits of the first segments that are compared before complete distances, and how many may differ: two standard deviations over the share.
FIRST, FIRST_DISTANCE = 60, 20
#: Members of a table entry up to which each meets each; rows that go (40 bytes each) up to which they are broadcast to the texts.
CROWD, MAX_BROADCAST = 4, 500_000


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """The XXH64 of each shingle; none without words."""
    words = text.encode().lower().split()  # bytes: A-Z alone are lowered, and the six ASCII blanks alone split
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    stops = ends[shingle - 1 :] or ends[-1:]
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip([0, *ends[: n - 1]], stops)], np.uint64)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, from the highest on."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype(">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return total


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned integer; zero without words."""
    hashes = shingle_hashes(text, shingle)
    return int(np.packbits(2 * set_bits(hashes) > len(hashes)).view(">u8")[0])


def segments(text: str) -> np.ndarray:
    """The long fingerprint: of each segment its bits, from the lowest on, and above them the places of its least certain bits, five bits each.

    Different shingles count once. The bits beyond the first 64 come from the hash, mixed anew for each 64.
    """
    hashes = np.unique(shingle_hashes(text, LONG_SHINGLE))
    counts = []
    for lane in range(-(-SEGMENTS * WIDTH // 64)):
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * lane)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        counts.append(2 * set_bits(mixed ^ (mixed >> np.uint64(32))) - len(hashes))
    margins = np.concatenate(counts)[: SEGMENTS * WIDTH].reshape(SEGMENTS, WIDTH)
    bits = (margins > 0) @ (1 << np.arange(WIDTH, dtype=np.int64))
    loose = np.argsort(np.abs(margins), axis=1, kind="stable")[:, :LOOSE]
    return (bits.astype(np.uint64) | (loose.astype(np.uint64) << (WIDTH + 5 * np.arange(LOOSE, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)).view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        prints = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints)], names=["doc_id", "fp"])


def _segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 2):
        rows = [segments(t) for t in part.column(2).to_pylist()]
        flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, SEGMENTS, dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["id", "hash", "segments"])


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""
    return df.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _ball(part: Column, bits: int) -> Column:
    """The keys within one differing bit of a segment of ``bits`` bits."""
    return F.transform(F.array(F.lit(0), *[F.lit(1 << b) for b in range(bits)]).cast("array<long>"), lambda m: part.bitwiseXOR(m))


def _halves(rest: Column, bits: int) -> tuple[Column, Column]:
    """The high and the low half of the lowest ``bits`` bits."""
    return F.shiftrightunsigned(rest, bits // 2), rest.bitwiseAND((1 << bits // 2) - 1)


def _rest(sides: list[str]) -> Column:
    """What is left of a fingerprint when its halves ``sides`` are met by: the other half, and of that the other half."""
    rest, bits = F.col("fp"), 64
    for side in sides:
        high, low = _halves(rest, bits)
        rest, bits = F.when(F.col(side) == 0, low).otherwise(high), bits // 2
    return rest


def _cut(df: DataFrame, sides: list[str], side: str, bits: int) -> DataFrame:
    """``df`` twice: with the high (``side`` 0) and the low half (1) of what is left as ``own``."""
    high, low = _halves(_rest(sides), bits)
    return df.withColumn("__half", F.explode(F.array(F.struct(F.lit(0).alias("side"), high.alias("own")), F.struct(F.lit(1).alias("side"), low.alias("own"))))).withColumns({side: F.col("__half.side"), "own": F.col("__half.own")}).drop("__half")


def _met(table: DataFrame, probes: DataFrame, sides: list[str], keys: list[str], bits: int) -> DataFrame:
    """(a, b) of ``probes`` that meet entries of ``table`` (fp) under ``sides`` and ``keys`` and are near; of the fingerprints ``bits`` bits are left."""
    on = [*sides, *keys]
    xor = F.col("fp").bitwiseXOR(F.col("b"))
    near = (F.col("fp") < F.col("b")) & (F.bit_count(xor) <= DISTANCE)
    # of a pair that meets under both segments, one meeting counts
    once = (F.col(sides[0]) == 0) | (F.bit_count(F.shiftrightunsigned(xor, 32)) > 1)
    # always dealt by key: what is small enough for a broadcast here, is not at another size
    pairs = lambda p, t: p.join(t.select(*on, F.col("fp").alias("b")).hint("merge"), on).filter(near & once).select(F.col("fp").alias("a"), "b")
    if bits == 8:
        return pairs(probes, table)
    crowd = stored(table.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGE_BUCKET).drop("n"), "simhash-crowds")
    few = pairs(probes, table.join(crowd, on, "left_anti"))
    if crowd.isEmpty():
        return few
    side, key = f"side{bits}", f"key{bits}"
    entries = _cut(table.join(crowd, on, "left_semi"), sides, side, bits).withColumnRenamed("own", key)
    asked = _cut(probes.join(crowd, on, "left_semi"), sides, side, bits).withColumn(key, F.explode(_ball(F.col("own"), bits // 2))).drop("own")
    return few.unionByName(_met(entries, asked, [*sides, side], [*keys, key], bits // 2)).distinct()


def links(prints: DataFrame) -> DataFrame:
    """(a, b) with a < b: all pairs of distinct fingerprints of ``prints(fp)`` that differ in at most ``DISTANCE`` bits."""
    table = _cut(prints.select("fp"), [], "segment", 64)
    probes = table.withColumn("key", F.explode(_ball(F.col("own"), 32))).drop("own")
    return _met(table.withColumnRenamed("own", "key"), probes, ["segment"], ["key"], 32)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges(a, b)`` reaches. Rounds of large-star and small-star."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both if large else both.filter("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        spokes = (near.filter("v > u") if large else near).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
        dealt = least.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        out = spokes.join(dealt, ["u", "salt"]).select(F.col("m").alias("a"), F.col("v").alias("b"))
        if not large:
            out = out.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.filter("a <> b").distinct()

    state = None
    while True:
        edges = stored(star(star(edges, True), False), "simhash-stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = now


def _named(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of their ``key`` in ``names``, which holds each key once and n, the rows that have it."""
    total = names.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT > total
    hot = names.filter(is_hot).drop("n")  # fewer than HOT rows
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(names.filter(~is_hot).drop("n"), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def alike(nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b: links between alike nodes of ``nodes(fp, segments)`` that reach as far as those of all alike pairs that meet.

    Table entries are dealt and sorted by bucket once. Members of a bucket of up to ``CROWD`` meet each other. Of a larger
    one, those that are in it by their segment as it is, no bit turned, first meet the next and the first one: two others a
    segment. A pair of one component needs no link more. So in a second step, members of a large bucket that are not of the
    component that most of it belongs to meet all of its members of other components: no pair that could join two is left out.
    """
    mask = (1 << WIDTH) - 1
    share, bits = np.arccos(SIMILARITY) / np.pi, SEGMENTS * WIDTH
    differ = int(bits * share + SLACK * np.sqrt(bits * share * (1 - share)))
    as_it_is = 1 << FIRST  # a bit beside the first ones says that none was turned
    first = F.aggregate(F.slice("segments", 1, FIRST // WIDTH + 1), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, WIDTH).bitwiseOR(x.bitwiseAND(mask))).bitwiseAND(as_it_is - 1)
    close = lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseAND(as_it_is - 1)) <= FIRST_DISTANCE
    turned = lambda j: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(x, {WIDTH + 5 * j}) & 31 as int))")
    own = F.col("x").bitwiseAND(mask)
    ball = F.concat(F.array(own), *[F.array(own.bitwiseXOR(turned(j))) for j in range(LOOSE)])

    def verified(pairs: DataFrame) -> DataFrame:
        far = F.aggregate(F.zip_with("segments", "segments_b", lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseAND(mask))), F.lit(0), lambda a, x: a + x)
        both = pairs.join(nodes.withColumnRenamed("fp", "a"), "a").join(nodes.select(F.col("fp").alias("b"), F.col("segments").alias("segments_b")), "b")
        return stored(both.filter(far <= differ).select("a", "b"), "simhash-alike")

    cut = nodes.select("fp", first.alias("first"), F.posexplode("segments").alias("segment", "x"))
    table = cut.select("fp", "first", "segment", F.posexplode(ball).alias("turned", "key"))
    marked = F.when(F.col("turned") == 0, F.col("first").bitwiseOR(as_it_is)).otherwise(F.col("first")).alias("first")
    table = table.select("fp", marked, F.shiftleft(F.col("segment").cast("long"), WIDTH).bitwiseOR(F.col("key")).alias("bucket"))
    bucket = W.partitionBy("bucket")
    order = bucket.orderBy("fp")
    member = F.struct("fp", "first")
    shared = table.withColumn("n", F.count(F.lit(1)).over(bucket)).filter("n > 1")
    after = [F.lead(member, i).over(order) for i in range(1, CROWD)]
    lead = F.first(member).over(order.rowsBetween(W.unboundedPreceding, 0))
    nobody = F.array(F.struct(F.lit(None).cast("long").alias("fp"), F.lit(None).cast("long").alias("first")))  # marks a member of a crowd
    crowded = F.when(F.col("first") >= as_it_is, F.concat(nobody, F.array(after[0], lead))).otherwise(nobody)
    met = shared.select("bucket", "fp", "first", F.when(F.col("n") <= CROWD, F.array(*after)).otherwise(crowded).alias("met"))
    # distances are compared within the array, so that members that only happen to meet make no rows
    stays = lambda m, x: m.isNotNull() & (m["fp"].isNull() | ((m["fp"] != x["fp"]) & close(x["first"], m["first"])))
    kept = F.transform(F.array(F.struct("fp", "first", "met")), lambda x: F.filter(x["met"], lambda m: stays(m, x)))[0]
    met = met.select("bucket", "fp", "first", F.explode(kept).alias("m"))
    alone = F.col("m.fp").isNull()
    met = met.select(F.least("fp", "m.fp").alias("a"), F.when(~alone, F.greatest("fp", "m.fp")).alias("b"), F.when(alone, F.col("bucket")).alias("bucket"), F.when(alone, F.col("first")).alias("first"), alone.cast("int").alias("alone"))
    path = shared_path(nodes.sparkSession, "simhash-met")
    met.distinct().write.partitionBy("alone").parquet(path)
    met = nodes.sparkSession.read.schema("a long, b long, bucket long, first long, alone int").parquet(path)
    links = verified(met.filter("alone = 0").select("a", "b"))
    crowds = met.filter("alone = 1").select("bucket", F.col("a").alias("fp"), "first")
    if crowds.isEmpty():
        return links
    crowds = crowds.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    crowds = stored(crowds, "simhash-crowds")
    most = crowds.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("roots"))
    mixed = crowds.join(most.filter("roots > 1").drop("roots"), "bucket").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    others = mixed.filter("root <> most").select("bucket", F.col("fp").alias("o"), F.col("first").alias("o_first"), F.col("root").alias("o_root"))
    others = others.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    across = (mixed["bucket"] == others["bucket"]) & (mixed["salt"] == others["salt"]) & (F.col("root") != F.col("o_root")) & close(F.col("first"), F.col("o_first"))
    late = mixed.join(others.hint("merge"), across).select(F.least("fp", "o").alias("a"), F.greatest("fp", "o").alias("b")).distinct()
    return links.unionByName(verified(late))


def _classes(distinct: DataFrame, linked: DataFrame) -> DataFrame:
    """(fp, n, least): each of ``distinct(fp, n, least)`` with the least of all that it is linked to."""
    roots = components(linked)
    # every node but a root itself is listed
    classes = stored(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.col("n").alias("rows"), "least", F.coalesce("root", "fp").alias("root")), "simhash-classes")
    names = stored(classes.groupBy("root").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-names")
    return stored(_named(classes.drop("least"), names, "root").select("fp", F.col("rows").alias("n"), "least"), "simhash-named")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``df``; component_id is the smallest doc_id reachable."""
    members = stored(fingerprints(df, text, key), "simhash-prints")
    distinct = stored(members.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "simhash-distinct")
    classes = _classes(distinct, stored(links(distinct.select("fp")), "simhash-links")).withColumnRenamed("least", "component_id")
    return _named(members, classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _text_hash(text: Column) -> Column:
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(whole, F.octet_length(whole))


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of ``df`` of each group of texts that are alike by ``SIMILARITY`` in steps, all columns as they were.

    That with the smallest key stays (a null key is larger than any), of texts of one key that with the smallest hash, and of
    rows that agree in both the first by their columns as JSON. Rows are told apart by key and a hash of the text: those that
    go are a table without texts. It is broadcast up to ``MAX_BROADCAST`` rows; beyond, texts are shuffled once to meet it.
    """
    members = stored(df.select(F.col(key).cast("long").alias("id"), _text_hash(F.col(text)).alias("hash"), text_of(text).alias("text")).mapInArrow(_segmented, "id long, hash long, segments array<long>").withColumn("fp", F.xxhash64("segments")), "simhash-prints")
    row = F.struct(F.col("id").isNull().alias("nameless"), "id", "hash")
    distinct = stored(members.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("least"), F.first("segments").alias("segments")), "simhash-distinct")
    classes = _classes(distinct.drop("segments"), alike(distinct.select("fp", "segments")))
    ranked = _named(members.drop("segments"), classes, "fp").select("id", "hash", (row == F.col("least")).alias("stays"))
    counts = stored(ranked.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n"), F.first("stays").alias("stays")).filter("not stays or n > 1"), "simhash-gone")
    plain, columns = numbered(df)
    keyed = plain.withColumns({"id": F.col(columns[key]).cast("long"), "hash": _text_hash(F.col(columns[text]))})
    same = lambda c: keyed["id"].eqNullSafe(c["id"]) & (keyed["hash"] == c["hash"])
    few = counts.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    gone = F.broadcast(counts) if few else counts.hint("merge")
    rest = keyed.join(gone, same(counts), "left_anti").select(*columns.values())
    repeated = counts.filter("stays").select("id", "hash")
    if not repeated.isEmpty():
        again = keyed.join(repeated, same(repeated), "left_semi").withColumn("row", F.struct(*columns.values()))
        rest = rest.unionByName(again.groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
    return named(rest, columns)
