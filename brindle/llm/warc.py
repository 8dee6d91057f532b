"""WARC archives: records with revisits, and reading by boundary-chain verification.

Writing is all DataFrame expressions and Spark's text writer, whose line separator is the record's closing blank line.
Pages with equal payloads are found by digest (one map-side aggregation). Groups of more than one are joined back by a
broadcast while they are few, so that payloads are not shuffled at all, and under a salted key beyond that.

Reading splits archives natively at the magic ``WARC/1.``, also inside of payloads. Each piece is a *candidate* record
with an offset and, by its Content-Length, the offset of its successor. Only what the chain of successors from the file's
start reaches is a record. A header that holds the magic, say in its url, goes on in the pieces behind, up to the next
blank line. Chains are followed by pointer jumping over runs of adjacent candidates: a run within one file
block is one node, so that the rounds are logarithmic in the number of blocks, not of records. A record that holds the
magic spans several pieces and is put together in a second pass over its file.

Defined results: a null payload is the empty payload; a null url is the empty one; a page with a null id has no id to be
revisited by, and revisits if its group has one; rows that repeat the largest id of their group are all responses; an
empty table gives an empty archive and an empty result; extra columns never enter. A record cut off by the end of its
file is not whole and is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_path, shared_root, stored

MAGIC = "WARC/1."
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Groups of equal payloads (about 60 bytes each) up to which they are broadcast; parts that the rows of one are dealt to beyond.
MAX_BROADCAST, SALTS = 100_000, 16
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """The upper-case base32 form of the SHA-1 of a binary column."""
    digest = F.sha1(payload)
    quads = [F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(q, s).bitwiseAND(31) + 1, F.lit(1)) for q in quads for s in (15, 10, 5, 0)])


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(value): each page as a WARC record without its closing blank line."""
    rows = pages.select(F.col(key).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), "[\\r\\n]", "").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("body"))
    rows = rows.withColumn("digest", base32_sha1(F.col("body")))
    groups = rows.groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = stored(groups.drop("n"), "warc-groups")
    if groups.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        rows = rows.join(F.broadcast(groups), "digest", "left")
    else:
        salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    size = F.octet_length("body")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(END))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">\r\n"))
    head = F.concat(
        F.lit(f"{MAGIC}0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("id")),
        F.lit("WARC-Target-URI: "), F.col("url"), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("first")))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(size)).cast("string"), F.lit(END),
    )
    return rows.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("body").cast("string"))).alias("value"))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Archives of ``pages`` below ``path``, a file for each task, through Spark's committer."""
    records(pages, key, url, payload).write.option("lineSep", END).text(path)


def _field(name: str) -> Column:
    return F.regexp_extract("head", f"(?im)^{name}:[ \\t]*([^\\r\\n]*)", 1)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, body): what stands between the magics of each file, in the order of n within a block of the file."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("body"))


def _parsed(df: DataFrame) -> DataFrame:
    """``df`` with the fields of the record that begins at the magic before each ``body``, as far as the piece holds it."""
    cut = F.instr("body", END)
    df = df.withColumn("head", F.when(cut > 0, F.substring("body", F.lit(1), cut - 1)))
    opens = F.col("body").rlike("^[01]\\r\\n")
    df = df.withColumn("content", F.when(opens, _field("Content-Length").try_cast("long")))
    # for a header that goes on behind a magic: no line begins or ends at the magics around the piece
    lines = F.concat(F.lit(MAGIC), F.coalesce(F.concat("head", F.lit("\r\n")), F.concat("body", F.lit(MAGIC))))
    size = "(?im)^Content-Length:[ \\t]*([^\\r\\n]*)"
    df = df.withColumns({"opens": opens, "ends": F.octet_length("head").cast("long"), "size": F.when(F.regexp_extract(lines, size, 0) != "", F.regexp_extract(lines, size, 1))})
    df = df.withColumn("span", len(MAGIC) + F.octet_length("head") + 2 * len(END) + F.col("content"))
    block = F.substring(F.col("body").cast("binary"), F.octet_length("head") + len(END) + 1, F.col("content").cast("int"))
    df = df.withColumn("whole", F.coalesce(F.octet_length("body") + len(MAGIC) == F.col("span"), F.lit(False)))
    df = df.withColumn("record", F.when(F.col("whole"), block))
    http = F.instr(F.col("record").cast("string"), END)
    is_http = F.col("record").cast("string").startswith("HTTP/") & (http > 0)
    payload = F.when(is_http, F.expr(f"substring(record, instr(cast(record as string), '\\r\\n\\r\\n') + {len(END)})")).otherwise(F.col("record"))
    stated = F.regexp_extract(F.when(is_http, F.substring(F.col("record").cast("string"), F.lit(1), http)).otherwise(""), "(?im)^Content-Length:[ \\t]*([0-9]+)", 1).try_cast("long")
    return df.select(
        *[c for c in ("file", "block", "n", "offset") if c in df.columns], (F.octet_length("body") + len(MAGIC)).cast("long").alias("length"), "span", "whole", "opens", "ends", "size",
        F.lower(_field("WARC-Type")).alias("type"), _field("WARC-Record-ID").alias("record_id"), _field("WARC-Refers-To").alias("refers_to"), _field("WARC-Target-URI").alias("url"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "(?i)^sha1:", "").alias("stated_digest"), stated.alias("stated_bytes"), F.octet_length(payload).cast("long").alias("bytes"), base32_sha1(payload).alias("digest"),
    )


def _placed(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the offset of the magic before each, from sums within a block and over the blocks of a file."""
    inner = W.partitionBy("file", "block").orderBy("n")
    rows = pieces.withColumn("__before", F.sum("length").over(inner) - F.col("length"))
    blocks = pieces.groupBy("file", "block").agg(F.sum("length").alias("__all"))
    blocks = blocks.withColumn("__from", F.sum("__all").over(W.partitionBy("file").orderBy("block")) - F.col("__all")).drop("__all")
    return rows.join(blocks, ["file", "block"]).withColumn("offset", F.col("__from") + F.col("__before") - len(MAGIC)).drop("__before", "__from")


def _headed(placed: DataFrame) -> DataFrame:
    """``placed`` with the spans of those candidates too whose header holds the magic and so goes on in the pieces behind."""
    if placed.filter("opens and ends is null").isEmpty():
        return placed
    inner = W.partitionBy("file", "block").orderBy("n")
    # a piece without the blank line, and the piece after it; of a block's first piece that isn't known
    near = placed.withColumn("after", F.coalesce(F.lag(F.col("ends").isNull()).over(inner), F.lit(True))).filter("ends is null or after")
    back = W.partitionBy("file").orderBy(F.col("offset").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.last(F.when(F.col("ends").isNotNull(), F.struct("offset", "ends")), ignorenulls=True).over(back)
    size = F.last(F.when(F.col("size").isNotNull(), F.struct("offset", F.col("size").try_cast("long").alias("content"))), ignorenulls=True).over(back)
    near = near.select("file", "offset", "opens", F.col("ends").alias("own"), end.alias("end"), size.alias("size")).filter("opens and own is null and size.offset <= end.offset")
    spans = near.select("file", "offset", (F.col("end.offset") + len(MAGIC) + F.col("end.ends") + 2 * len(END) + F.col("size.content") - F.col("offset")).alias("__span"))
    return placed.join(spans, ["file", "offset"], "left").withColumn("span", F.coalesce("span", "__span")).drop("__span")


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, offset) of the candidates (file, block, offset, length, successor) that the chain from offset 0 of each file reaches."""
    shared_root(candidates.sparkSession)
    inner = W.partitionBy("file", "block").orderBy("offset")
    nodes = candidates.withColumn("adjacent", F.coalesce(F.lag("successor").over(inner) == F.col("offset"), F.lit(False)))
    jumps = candidates.filter("successor <> offset + length").select("file", F.col("successor").alias("offset"), F.lit(True).alias("entered")).distinct()
    nodes = nodes.join(jumps, ["file", "offset"], "left")
    head = F.when(~F.col("adjacent") | F.col("entered").isNotNull(), F.col("offset"))
    nodes = nodes.withColumn("run", F.last(head, ignorenulls=True).over(inner)).select("file", "offset", "run", "successor")
    nodes = stored(nodes, "warc-runs")
    step = nodes.groupBy("file", "run").agg(F.max_by("successor", "offset").alias("to"))
    reached = step.filter("run = 0").select("file", "run")
    count = -1
    while True:
        reached, step = reached.checkpoint(), step.checkpoint()
        now = reached.count()
        if now == count:
            break
        count = now
        ahead = reached.join(step, ["file", "run"]).select("file", F.col("to").alias("run")).join(step.select("file", "run"), ["file", "run"], "left_semi")
        twice = step.alias("a").join(step.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.run"))).select("a.file", "a.run", F.col("b.to").alias("to"))
        reached, step = reached.union(ahead).distinct(), step.select("file", "run").join(twice, ["file", "run"], "left").select("file", "run", "to")
    return nodes.join(reached, ["file", "run"], "left_semi").select("file", "offset")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, type, record_id, refers_to, url, payload_bytes, payload_digest) of each record of the archives below ``path``.

    Size and digest are those of the payload as read; of a revisit, which holds none, those that its headers state.
    """
    parsed = stored(_parsed(_pieces(spark, path)), "warc-pieces")
    placed = _headed(_placed(parsed)).filter("span is not null").withColumn("successor", F.col("offset") + F.col("span"))
    chain = reachable(placed.select("file", "block", "offset", "length", "successor"))
    found = placed.join(chain, ["file", "offset"], "left_semi")
    columns = ["file", "offset", "type", "record_id", "refers_to", "url", "stated_bytes", "stated_digest", "bytes", "digest"]
    out = found.filter("whole").select(columns)
    torn = stored(found.filter("not whole").select("file", "offset", "span"), "warc-torn")
    if not torn.isEmpty():
        out = out.unionByName(_joined(spark, path, torn).select(columns))
    revisit = F.col("type") == "revisit"
    return out.select("file", "offset", "type", "record_id", "refers_to", "url", F.when(revisit, F.coalesce("stated_bytes", "bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), F.when(revisit, F.col("stated_digest")).otherwise(F.col("digest")).alias("payload_digest"))


def _joined(spark: SparkSession, path: str, torn: DataFrame) -> DataFrame:
    """The records that several pieces make up, parsed whole. ``torn``: their file, offset and span."""
    pieces = _pieces(spark, path).join(torn.select("file").distinct(), "file", "left_semi").withColumn("length", (F.octet_length("body") + len(MAGIC)).cast("long"))
    pieces = stored(pieces, "warc-bodies")
    placed = _placed(pieces)
    starts = torn.select("file", "offset", "span", F.lit(0).alias("piece"))
    every = placed.select("file", "offset", F.lit(None).cast("long").alias("span"), F.lit(1).alias("piece"))
    order = W.partitionBy("file").orderBy("offset", "piece")
    owner = F.last(F.when(F.col("piece") == 0, F.struct("offset", "span")), ignorenulls=True).over(order)
    owned = starts.unionByName(every).withColumn("own", owner).filter("piece = 1 and offset >= own.offset and offset < own.offset + own.span")
    spread = owned.select("file", "offset", "own").join(placed.select("file", "offset", "body"), ["file", "offset"])  # bodies don't pass the window
    whole = spread.groupBy("file", F.col("own.offset").alias("start"), F.col("own.span").alias("size")).agg(F.sort_array(F.collect_list(F.struct("offset", "body"))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p["body"]), MAGIC)
    return _parsed(whole.select("file", F.col("start").alias("offset"), body.alias("body"))).filter("whole")


def page_records(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url): ``pages`` written as archives and read back."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path)
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    rows = read(pages.sparkSession, path)
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"), "url")
