"""Media columns: baseline JPEG written and parsed in numpy.

A payload is stored losslessly as the *quantised coefficients* of 8x8 blocks, the unit that a baseline JPEG codes without
loss: byte i of each 64 is the coefficient at zigzag place i. Frequent bytes get small coefficients, which the Huffman
tables code in few bits. Restart markers every few blocks make the scan's intervals independent, so that intervals of
all images of a batch are decoded in lockstep, one symbol of each at a time, by table lookup in numpy.

The reader parses markers (SOF0, DHT, DQT, DRI, SOS, COM), also of files from elsewhere with several components, and
rebuilds the thumbnail from the DC coefficients of the luminance alone: one pixel a block, no inverse transform.

Work is one narrow pass each for writing and reading; a long payload is coded in parts. Defined results: a null text is
the empty text (64 zero bytes); an empty table gives an empty result; repeated rows come out each; extra columns never
enter; bytes that are no baseline JPEG have null features.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_of

BLOCK = 64
#: Blocks of a restart interval, blocks of a row of the image, payload blocks coded at once.
INTERVAL, ROW, PART = 8, 64, 1 << 14
BATCH_BYTES = 1 << 20

#: The luminance Huffman tables of the JPEG standard, as codes of each length and symbols in their order.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_SYMBOLS = tuple(range(12))
AC_COUNTS = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125)
AC_FIRST = (
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32,
    0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82,
)
#: The other symbols, run and size, follow in ascending order.
AC_SYMBOLS = AC_FIRST + tuple(s for s in (r << 4 | n for r in range(16) for n in range(1, 11)) if s not in AC_FIRST)

#: Short tables for payloads without zero bytes inside, which need no runs; (symbol, code length), most frequent sizes first.
SHORT_DC = ((3, 2), (4, 2), (2, 3), (5, 3), (1, 4), (0, 5), (6, 5), (7, 6), (8, 7), (9, 8))
SHORT_AC = ((3, 2), (2, 2), (1, 2), (4, 3), (5, 4), (6, 5), (0, 6), (7, 7), (8, 8))

#: Bytes in the order of their coefficients 0, 1, -1, 2, -2, ...: zero, common ones of Latin text in UTF-8, the rest ascending.
COMMON = b"\x00 etaoinsrhldcumfgpwbyvk.,\nqzjx\xc3\xa9\xa4\xbc\xb3\xa8\xad\xb1\xb6\xaa\xa0\xa1\xa7\x9f-'\"0123456789STAEDCIMRNLPBUOFGHVWK"
RANKED = COMMON + bytes(b for b in range(256) if b not in COMMON)
LEVEL = np.zeros(256, np.int16)
LEVEL[list(RANKED)] = [(r + 1) // 2 * (1 if r % 2 else -1) for r in range(256)]
BYTE = np.zeros(512, np.uint8)
BYTE[LEVEL + 256] = np.arange(256)


def codes(counts: tuple[int, ...], symbols: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a canonical Huffman table."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


@lru_cache(maxsize=64)
def lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> np.ndarray:
    """length << 8 | symbol for every 16 bits that a code can begin; 0 where no code does."""
    table = np.zeros(1 << 16, np.int64)
    for symbol, code, length in codes(counts, symbols):
        table[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
    return table


def _coder(counts: tuple[int, ...], symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    value, length = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for symbol, code, n in codes(counts, symbols):
        value[symbol], length[symbol] = code, n
    return value, length


def _short(table: tuple[tuple[int, int], ...]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    return tuple(sum(n == length for _, n in table) for length in range(1, 17)), tuple(s for s, _ in table)


#: Counts and symbols of the DC and the AC table, by whether runs of zeros occur.
HUFFMAN = {True: ((DC_COUNTS, DC_SYMBOLS), (AC_COUNTS, AC_SYMBOLS)), False: (_short(SHORT_DC), _short(SHORT_AC))}
CODERS = {runs: tuple(_coder(*t) for t in tables) for runs, tables in HUFFMAN.items()}
SIZE = np.array([int(i).bit_length() for i in range(2048)], np.int64)


def _coded(values: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, coder: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Code and magnitude bits of each value in one number, and their number of bits."""
    bits = np.where(values < 0, values + (1 << sizes) - 1, values)
    return coder[0][symbols] << sizes | bits, coder[1][symbols] + sizes


def scans(levels: np.ndarray, ends: np.ndarray, runs: bool) -> list[bytes]:
    """Entropy-coded bytes of restart intervals, byte-stuffed. levels: blocks x 64 coefficients; ends: last block of each interval."""
    dc_code, ac_code = CODERS[runs]
    n = len(levels)
    dc = levels[:, 0].astype(np.int64)
    diff = np.diff(dc, prepend=0)
    begins = np.concatenate(([0], ends[:-1] + 1))
    diff[begins] = dc[begins]
    ac = levels[:, 1:]
    row, k = np.nonzero(ac)
    value = ac[row, k].astype(np.int64)
    new = np.diff(row, prepend=-1) != 0
    run = np.where(new, k, np.diff(k, prepend=0) - 1)
    extra = run >> 4  # sixteen zeros each
    last = np.full(n, -1)
    last[row] = k
    end_code = last != 62
    per_block = 1 + np.bincount(row, 1 + extra, minlength=n).astype(np.int64) + end_code
    padded = np.zeros(n, np.int64)
    padded[ends] = 1
    begin = np.cumsum(per_block + padded) - per_block - padded
    total = int((per_block + padded).sum())
    item, length = np.zeros(total, np.int64), np.zeros(total, np.int64)
    sizes = SIZE[np.abs(diff)]
    item[begin], length[begin] = _coded(diff, sizes, sizes, dc_code)
    done = np.cumsum(1 + extra)
    before = np.concatenate(([0], done))[np.searchsorted(row, np.arange(n))]  # items of earlier blocks
    place = begin[row] + done - before[row]
    sizes = SIZE[np.abs(value)]
    item[place], length[place] = _coded(value, sizes, (run & 15) << 4 | sizes, ac_code)
    for z in range(1, 4):  # at most three runs of sixteen
        at = place[extra >= z] - z
        item[at], length[at] = ac_code[0][0xF0], ac_code[1][0xF0]
    at = (begin + per_block - 1)[end_code]
    item[at], length[at] = ac_code[0][0], ac_code[1][0]
    sums = np.cumsum(length)
    at = begin[ends] + per_block[ends]  # ones up to the next whole byte
    bits = np.diff(sums[at], prepend=0)
    fill = -bits % 8
    item[at], length[at] = (1 << fill) - 1, fill
    sums = np.cumsum(length)
    offset = sums - length
    shifted = item.astype(np.uint64) << (64 - (offset & 31) - length).astype(np.uint64)
    words = int(sums[-1] + 31 >> 5) + 2
    word = offset >> 5
    packed = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), words) + np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    data = packed.astype(">u4").view(np.uint8)[: int(sums[-1]) // 8]
    full = np.flatnonzero(data == 255)
    stops = sums[at] // 8
    stops = (stops + np.searchsorted(full, stops)).tolist()
    raw = np.insert(data, full + 1, 0).tobytes()
    return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops)]


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


TABLES = {runs: _segment(0xC4, b"".join(bytes([kind, *counts, *symbols]) for kind, (counts, symbols) in zip((0x00, 0x10), tables))) for runs, tables in HUFFMAN.items()}
QUANTISERS = _segment(0xDB, b"\x00" + bytes([1] * 64))


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A grayscale baseline JPEG for each payload (a positive multiple of 64 bytes). The comment segment holds its number of blocks."""
    heads, rows = [], []
    runs = [0 in p.rstrip(b"\x00") for p in payloads]
    for p, r in zip(payloads, runs):
        blocks = len(p) // BLOCK
        wide = min(blocks, max(ROW, -(-blocks // 8191)))
        high = -(-blocks // wide)
        heads.append(
            b"\xff\xd8" + _segment(0xFE, f"blocks={blocks}".encode()) + QUANTISERS
            + _segment(0xC0, b"\x08" + (8 * high).to_bytes(2, "big") + (8 * wide).to_bytes(2, "big") + b"\x01\x01\x11\x00")
            + TABLES[r] + _segment(0xDD, INTERVAL.to_bytes(2, "big")) + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
        )
        rows.append(wide * high)
    parts: list[list[bytes]] = [[] for _ in payloads]
    for kind in (False, True):
        group: list[tuple[int, int, int]] = []
        size = 0
        for i, a, b in ((i, a, min(a + PART, n)) for i, n in enumerate(rows) if runs[i] == kind for a in range(0, n, PART)):  # PART is whole intervals
            group.append((i, a, b))
            size += b - a
            if size >= PART:
                _code(payloads, group, kind, parts)
                group, size = [], 0
        if group:
            _code(payloads, group, kind, parts)
    restarts = [bytes((0xFF, 0xD0 + i)) for i in range(8)]
    out = []
    for head, intervals in zip(heads, parts):
        body = [x for i, part in enumerate(intervals) for x in ((restarts[(i - 1) % 8], part) if i else (part,))]
        out.append(b"".join([head, *body, b"\xff\xd9"]))
    return out


def _code(payloads: list[bytes], group: list[tuple[int, int, int]], runs: bool, parts: list[list[bytes]]) -> None:
    """Adds the coded intervals of blocks a to b of payloads i to ``parts``, for each (i, a, b) of ``group``."""
    levels, ends, at = [], [], 0
    for i, a, b in group:
        own = np.frombuffer(payloads[i][a * BLOCK : b * BLOCK], np.uint8)
        levels += [LEVEL[own], np.zeros((b - a) * BLOCK - len(own), np.int16)]  # blocks that fill the last row are zero
        ends.append(at + np.append(np.arange(INTERVAL - 1, b - a - 1, INTERVAL), b - a - 1))
        at += b - a
    coded, at = scans(np.concatenate(levels).reshape(-1, BLOCK), np.concatenate(ends), runs), 0
    for (i, _, _), e in zip(group, ends):
        parts[i] += coded[at : at + len(e)]
        at += len(e)


@dataclass
class Image:
    """What the markers of a baseline JPEG say."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal and vertical sampling, quantiser
    chosen: list[tuple[tuple, tuple]] = field(default_factory=list)  # DC and AC table of each component
    quantisers: dict[int, int] = field(default_factory=dict)  # of the DC coefficient
    interval: int = 0
    comment: bytes = b""
    data: bytes = b""

    @property
    def pattern(self) -> tuple[int, ...]:
        """The component of each block of a unit of the scan."""
        if len(self.components) == 1:
            return (0,)
        return tuple(c for c, (_, h, v, _) in enumerate(self.components) for _ in range(h * v))

    @property
    def units(self) -> tuple[int, int]:
        h, v = (1, 1) if len(self.components) == 1 else (max(c[1] for c in self.components), max(c[2] for c in self.components))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parsed(data: bytes) -> Image:
    """The markers of a baseline JPEG with one scan, and its entropy-coded bytes."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, tables, at = Image(), {}, 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                n = sum(counts)
                tables[body[0]] = (counts, tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xDD:
            image.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            image.comment = body
        elif marker == 0xDA:
            named = {body[i]: body[i + 1] for i in range(1, 1 + 2 * body[0], 2)}
            if set(named) != {c[0] for c in image.components}:
                raise ValueError("more than one scan")
            image.chosen = [(tables[named[c[0]] >> 4], tables[0x10 | named[c[0]] & 15]) for c in image.components]
            stop = data.rfind(b"\xff\xd9")
            image.data = data[at : stop if stop >= at else len(data)]
            return image
        elif marker == 0xD9:
            raise ValueError("no scan")


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """Blocks x 64 coefficients of each image in scan order, DC ones with their predictions added."""
    out: list[np.ndarray] = [np.zeros(0)] * len(images)
    alike = defaultdict(list)
    for i, image in enumerate(images):
        alike[image.pattern, tuple(image.chosen)].append(i)
    for (pattern, chosen), own in alike.items():
        for i, c in zip(own, _lockstep([images[i] for i in own], pattern, chosen)):
            out[i] = c
    return out


def _lockstep(images: list[Image], pattern: tuple[int, ...], chosen: tuple) -> list[np.ndarray]:
    raw = np.frombuffer(b"".join(x for image in images for x in (image.data, b"\xff\xd0")), np.uint8)  # a boundary behind each image
    mark = np.flatnonzero(raw[:-1] == 255)
    follow = raw[mark + 1]
    stuffed, restart = mark[follow == 0], mark[(follow & 0xF8) == 0xD0]
    drop = np.concatenate((stuffed + 1, restart, restart + 1))
    keep = np.ones(len(raw), bool)
    keep[drop] = False
    kept_before = np.concatenate(([0], np.cumsum(keep)))
    starts = np.concatenate(([0], kept_before[restart]))[:-1]
    units = [image.units[0] * image.units[1] for image in images]
    of = [-(-u // image.interval) if image.interval else 1 for u, image in zip(units, images)]
    if sum(of) != len(starts):
        raise ValueError("restart markers don't fit the image's size")
    per = len(pattern)
    blocks = np.concatenate([np.minimum((image.interval or u), u - np.arange(n) * image.interval) for u, n, image in zip(units, of, images)]) * per
    first = np.cumsum(blocks) - blocks
    levels = np.zeros(int(blocks.sum()) * 64, np.int16)
    bytes_ = np.concatenate((raw[keep], np.full(16, 255, np.uint8)))
    windows = np.ndarray((len(bytes_) - 8,), ">u8", bytes_.tobytes(), strides=(1,)).astype(np.uint64)
    table = np.concatenate([lookup(*t) for pair in chosen for t in pair])
    base = np.array([c << 17 for c in pattern])
    pos, block, stop, k = starts * 8, first.copy(), first + blocks, np.zeros(len(starts), np.int64)
    origin = first.copy()
    last = len(windows) - 1
    one, top = np.uint64(1), np.uint64(63)
    while len(pos):
        w = windows[np.minimum(pos >> 3, last)] << (pos & 7).astype(np.uint64)
        is_ac = k > 0
        at = (w >> np.uint64(48)).astype(np.int64) + (is_ac << 16)
        if per > 1 or len(chosen) > 1:
            at += base[(block - origin) % per]
        entry = table[at]
        length, symbol = entry >> 8, entry & 255
        if not length.all():
            raise ValueError("no Huffman code")
        size = symbol & 15
        run = (symbol >> 4) * is_ac
        bits = ((w << length.astype(np.uint64)) >> one >> (top - size.astype(np.uint64))).astype(np.int64)
        value = np.where(bits >> np.maximum(size - 1, 0), bits, bits - (1 << size) + 1)
        pos += length + size
        to = np.minimum(k + run, 63)
        levels[block * 64 + to] = value
        k = np.where(is_ac & (symbol == 0), 64, to + 1)
        over = k > 63
        if over.any():
            block = block + over
            k[over] = 0
            live = block < stop
            if not live.all():
                pos, block, stop, k, origin = pos[live], block[live], stop[live], k[live], origin[live]
    levels = levels.reshape(-1, 64)
    which = np.arange(len(levels))
    lane = np.repeat(np.arange(len(first)), blocks)
    part = np.array(pattern)[(which - first[lane]) % per]
    for c in range(len(chosen)):
        own = which[part == c]
        total = np.cumsum(levels[own, 0].astype(np.int64))
        new = np.flatnonzero(np.diff(lane[own], prepend=-1))
        before = np.concatenate(([0], total))[new]
        levels[own, 0] = total - before[np.cumsum(np.bincount(new, minlength=len(own))) - 1]
    return np.split(levels, np.cumsum([u * per for u in units])[:-1])


def thumbnail(image: Image, levels: np.ndarray) -> np.ndarray:
    """One pixel for each block of the luminance, from the DC coefficients."""
    across, down = image.units
    dc = levels[:, 0].astype(np.int64)
    h = v = 1
    if len(image.components) > 1:
        _, h, v, _ = image.components[0]
        dc = dc.reshape(-1, len(image.pattern))[:, : h * v].reshape(down, across, v, h).transpose(0, 2, 1, 3)
    dc = dc.reshape(down * v, across * h)
    hmax, vmax = (max(c[1] for c in image.components), max(c[2] for c in image.components)) if len(image.components) > 1 else (1, 1)
    dc = dc[: -(-image.height * v // (8 * vmax)), : -(-image.width * h // (8 * hmax))]
    return np.clip(dc * image.quantisers[image.components[0][3]] // 8 + 128, 0, 255).astype(np.uint8)


def feature(image: Image, levels: np.ndarray) -> str:
    """Dimensions, the average hash of the thumbnail over a grid of 8x8, and the checksum of the thumbnail."""
    small = thumbnail(image, levels)
    high, wide = small.shape
    sums = np.pad(small.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    r0, c0 = np.arange(8) * high // 8, np.arange(8) * wide // 8
    r1, c1 = np.maximum((np.arange(8) + 1) * high // 8, r0 + 1), np.maximum((np.arange(8) + 1) * wide // 8, c0 + 1)
    mean = (sums[r1][:, c1] - sums[r0][:, c1] - sums[r1][:, c0] + sums[r0][:, c0]) / ((r1 - r0)[:, None] * (c1 - c0)[None, :])
    bits = np.packbits((mean > mean.mean()).reshape(-1)).tobytes().hex()
    return f"{image.width}x{image.height}:{bits}:{zlib.crc32(small.tobytes()):08x}"


def payload(image: Image, levels: np.ndarray) -> bytes:
    """The bytes that ``encode`` stored."""
    blocks = int(image.comment.decode().removeprefix("blocks="))
    return BYTE[levels[:blocks].reshape(-1) + 256].tobytes()


def media(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a JPEG; n_bytes without the padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=BATCH_BYTES):
            raw = [t.encode() for t in part.column(1).to_pylist()]
            cols = [pa.array([len(r) for r in raw], pa.int64()), pa.array(encode([padded(r) for r in raw]), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "n_bytes", "media"])

    return df.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def thumbnails(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """(doc_id, width, height, feature) of a column of baseline JPEGs; null where the bytes are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=BATCH_BYTES):
            rows = []
            for data in part.column(1).to_pylist():
                try:
                    image = parsed(data or b"")
                    rows.append((image.width, image.height, feature(image, coefficients([image])[0])))
                except (ValueError, KeyError, IndexError):
                    rows.append((None, None, None))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "width", "height", "feature"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(media).cast("binary").alias("media")).mapInArrow(run, "doc_id long, width int, height int, feature string")


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of what ``media`` made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for part in slices(batches, 2, BATCH_BYTES):
            files = part.column(2).to_pylist()
            images = [parsed(f) for f in files]
            rows = []
            for f, image, levels in zip(files, images, coefficients(images)):
                data = payload(image, levels)
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(f), hashlib.sha256(f).hexdigest(), feature(image, levels)))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=[c.split()[0] for c in READ.split(", ")])

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, READ)


def round_trip(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text stored as a JPEG in the shared folder, read back, and measured."""
    return read_back(stored(media(df, text, key), "media"))
