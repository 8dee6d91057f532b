"""JPEG and WARC: exact round trips, a plain decoder, archives with magic inside payloads."""

import base64
import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import media, warc

random.seed(5)
TEXTS = [None, "", "a", "x" * 63, "x" * 64, "é" * 900, "The quick brown fox. " * 400, "\x00a\x00\x00b" * 500, "z" * 700_000, "same", "same"]


def plain_decode(image):
    """Coefficients of an image by one bit after the other, for comparison."""
    tables = [{(n, code): s for s, code, n in media.codes(*t)} for pair in image.chosen for t in pair]
    segments, at = [], 0
    data = image.data
    part = bytearray()
    while at < len(data):
        if data[at] == 0xFF and data[at + 1] == 0:
            part.append(0xFF)
            at += 2
        elif data[at] == 0xFF:
            segments.append(bytes(part))
            part = bytearray()
            at += 2
        else:
            part.append(data[at])
            at += 1
    segments.append(bytes(part))
    units, out = image.units[0] * image.units[1], []
    for n, seg in enumerate(segments):
        bits = "".join(f"{b:08b}" for b in seg)
        at = 0
        last = [0] * len(image.components)

        def symbol(table):
            nonlocal at
            for n in range(1, 17):
                if (n, int(bits[at : at + n], 2)) in table:
                    at += n
                    return table[n, int(bits[at - n : at], 2)]
            raise ValueError

        def value(size):
            nonlocal at
            raw = bits[at : at + size]
            at += size
            return 0 if not size else int(raw, 2) if raw[0] == "1" else int(raw, 2) - (1 << size) + 1

        per = image.interval or units
        for _ in range(min(per, units - n * per)):
            for c in image.pattern:
                block = [0] * 64
                last[c] += value(symbol(tables[2 * c]))
                block[0], k = last[c], 1
                while k < 64:
                    s = symbol(tables[2 * c + 1])
                    if s == 0:
                        break
                    k += s >> 4
                    block[k] = value(s & 15)
                    k += 1
                out.append(block)
    return np.array(out)


def colour_jpeg():
    """A 20 x 20 image of three components with 2x2 luminance sampling and no restart markers, made by hand."""
    dc, ac = (media.DC_COUNTS, media.DC_SYMBOLS), (media.AC_COUNTS, media.AC_SYMBOLS)
    dc_code, ac_code = ({s: f"{c:0{n}b}" for s, c, n in media.codes(*t)} for t in (dc, ac))
    bits, last, truth = "", [0] * 3, []
    for _ in range(4):  # 2 x 2 units of 16 x 16 pixels
        for c in (0, 0, 0, 0, 1, 2):
            block = [random.randint(-200, 200)] + [random.choice([0] * 9 + [-3, 1, 40]) for _ in range(63)]
            truth.append(block)
            size = lambda v: abs(v).bit_length()
            amp = lambda v: f"{v if v > 0 else v + (1 << size(v)) - 1:0{size(v)}b}" if v else ""
            d = block[0] - last[c]
            last[c] = block[0]
            bits += dc_code[size(d)] + amp(d)
            run = 0
            for v in block[1:]:
                if v == 0:
                    run += 1
                    continue
                bits += ac_code[0xF0] * (run // 16) + ac_code[(run % 16) << 4 | size(v)] + amp(v)
                run = 0
            bits += ac_code[0] if run else ""
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    frame = b"\x08\x00\x14\x00\x14\x03" + b"\x01\x22\x00" + b"\x02\x11\x00" + b"\x03\x11\x00"
    head = b"\xff\xd8" + media._segment(0xE0, b"JFIF\x00") + media._segment(0xDB, b"\x00" + bytes([8] * 64)) + media._segment(0xC0, frame) + media.TABLES[True]
    return head + media._segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + data + b"\xff\xd9", np.array(truth)


def test_jpeg_round_trip_and_plain_decoder():
    payloads = [media.padded(os.urandom(n)) for n in (0, 1, 64, 65, 5000)] + [media.padded((t or "").encode()) for t in TEXTS]
    images = [media.parsed(f) for f in media.encode(payloads)]
    for image, levels, p in zip(images, media.coefficients(images), payloads):
        assert media.payload(image, levels) == p
        if len(p) < 10_000:
            assert (plain_decode(image) == levels).all()


def test_foreign_colour_jpeg():
    data, truth = colour_jpeg()
    image = media.parsed(data)
    (levels,) = media.coefficients([image])
    assert (levels == truth).all() and (plain_decode(image) == truth).all()
    small = media.thumbnail(image, levels)
    assert small.shape == (3, 3) and small[0, 0] == np.clip(truth[0][0] + 128, 0, 255) and small[2, 2] == np.clip(truth[18][0] + 128, 0, 255)


def test_media_columns(spark, docs):
    df = docs(TEXTS, feature="clash", media="clash")
    rows = {r.doc_id: r for r in media.round_trip(df).collect()}
    stored = {r.doc_id: r.media for r in media.media(df).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
    assert rows[9].feature == rows[10].feature and rows[6].feature != rows[8].feature
    assert media.round_trip(df.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, b"no image"), (2, None), (3, bytes(colour_jpeg()[0]))], "doc_id long, media binary")
    got = {r.doc_id: r for r in media.thumbnails(bad).collect()}
    assert got[1].feature is None and got[2].width is None and (got[3].width, got[3].height) == (20, 20)


def inner_record(body):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"


PAGES = [
    "<p>one</p>", "<p>two</p>", "<p>one</p>", None, "", "WARC/1.0\r\nno header", "talk of WARC/1.0 and WARC/1. and\r\n\r\nmore", inner_record("fake"), "x" + inner_record("fake") + inner_record("again"),
    inner_record("é" * 100), "WARC/1.", "\r\n\r\n", "z" * 300_000, "<p>one</p>", inner_record("fake")[:-4],
]


def pages_df(spark, pages, first=0):
    return spark.createDataFrame([(first + i, f"http://h/{i}\r\nX: y" if i else None, h, "clash") for i, h in enumerate(pages)], "page_id long, url string, html string, digest string")


def expected_records(pages):
    out, best = {}, {}
    for i, h in enumerate(pages):
        best[h or ""] = i
    for i, h in enumerate(pages):
        raw = (h or "").encode()
        first = best[h or ""]
        out[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first == i else "revisit", None if first == i else first)
    return out


@pytest.mark.parametrize("split", ["128m", "300b", "57b"])
@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_warc_round_trip(spark, monkeypatch, split, broadcast):
    monkeypatch.setattr(warc, "MAX_BROADCAST", broadcast)
    pages = [*PAGES[:12], *PAGES[13:]] if split != "128m" else PAGES
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = warc.page_records(pages_df(spark, pages).coalesce(2)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == expected_records(pages)
    assert len(rows) == len(pages)


URLS = ["http://h/WARC/1.0", "WARC/1.", "http://h/WARC/1.0/WARC/1.1?q=WARC/1.", "http://h/plain", "%57ARC/1.0", "WARC/1.Content-Length: 7", "WARC/1.0 Content-Length: 7", "http://h/é/WARC/1.0", "http://h/WARC/1.0"]


@pytest.mark.parametrize("split", ["128m", "300b"])
def test_magic_in_urls(spark, split):
    bodies = ["<p>one</p>", None, inner_record("fake"), "WARC/1.0\r\nno header", "two", "WARC/1.0\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n", "é", "<p>one</p>", "last"]
    df = spark.createDataFrame(list(zip(range(len(URLS)), URLS, bodies)), "page_id long, url string, html string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = warc.page_records(df.coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.page_id, r.url) for r in rows) == list(enumerate(URLS))
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == expected_records(bodies)


def test_magic_in_other_headers(spark, tmp_path):
    odd = inner_record("first").replace("WARC-Record-ID", "X-Software: WARC/1.0\r\nWARC-Record-ID") + inner_record("second").replace("\r\n\r\n", "\r\nX-Last: a WARC/1.\r\n\r\n", 1)
    (tmp_path / "a.warc").write_bytes((odd + inner_record("third")).encode())
    assert [(r.record_id, r.payload_bytes) for r in warc.read(spark, str(tmp_path)).orderBy("offset").collect()] == [("<urn:page:99>", n) for n in (5, 6, 5)]


def test_warc_edges(spark):
    assert warc.page_records(pages_df(spark, ["a"]).limit(0)).count() == 0
    df = pages_df(spark, ["a", "a", "b"]).withColumn("page_id", F.when(F.col("page_id") > 0, F.col("page_id")))
    rows = {r.page_id: (r.record_type, r.refers_to) for r in warc.page_records(df).collect()}
    assert rows == {None: ("revisit", 1), 1: ("response", None), 2: ("response", None)}
    again = warc.page_records(pages_df(spark, ["a"]).unionByName(pages_df(spark, ["a"]))).collect()
    assert [r.record_type for r in again] == ["response", "response"]


def test_cut_off_record(spark, tmp_path):
    whole = inner_record("first") + inner_record("second").replace("WARC/1.0", "WARC/1.1")
    (tmp_path / "a.warc").write_bytes((whole + inner_record("third")[:-6]).encode())
    rows = warc.read(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r.offset, r.payload_bytes) for r in rows] == [(0, 5), (len(inner_record("first")), 6)]
    (tmp_path / "b.warc").write_bytes(b"no archive")
    assert warc.read(spark, str(tmp_path)).count() == 2


def test_repeated_media_rows(spark, docs):
    df = docs(TEXTS[:7])
    once, twice = ({tuple(r) for r in media.round_trip(x).collect()} for x in (df, df.unionByName(df)))
    assert once == twice and media.round_trip(df.unionByName(df)).count() == 14
