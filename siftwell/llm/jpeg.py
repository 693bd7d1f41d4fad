"""Baseline JPEG: a lossless carrier for byte payloads and a batched DC-only decoder.

*Carrier.* Every payload byte b becomes one flat 8x8 grey block whose pixels all
equal b: with a DC quantiser of 8 its DC coefficient is b - 128. A frame is 64
blocks wide, every row of blocks is a restart interval. So any baseline decoder
shows the payload as an image, and its DC-only thumbnail *is* the payload.

*Decoder.* Markers are parsed per image. Entropy-coded data is Huffman-decoded in
lockstep: each restart interval of each image in a batch is a lane, and one numpy
step advances all lanes by one symbol. AC coefficients are skipped, DC ones give
the luminance thumbnail at an eighth of the size.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import prepare, utf8

UNIT = 192
WIDE = 64
#: Rows of blocks in a frame; JPEG allows 65,535 pixels, and 192 bytes are 3 rows.
TALL = 8190
#: Payload bytes that are coded and decoded together; bounds memory.
BATCH = 1 << 20

# Code lengths of DC categories 0..11, chosen for differences of neighbouring text bytes.
_DC_LENGTHS = [5, 4, 4, 3, 2, 3, 4, 2, 6, 8, 8, 8]


def _canonical(lengths: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of the canonical code for (length, symbol) pairs in order."""
    code, last, out = 0, 0, {}
    for length, symbol in lengths:
        code <<= length - last
        out[symbol], last = (code, length), length
        code += 1
    return out


_DC_ORDER = sorted((n, s) for s, n in enumerate(_DC_LENGTHS))
_DC_CODE = _canonical(_DC_ORDER)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _dht(kind: int, order: list[tuple[int, int]]) -> bytes:
    counts = [sum(n == k for n, _ in order) for k in range(1, 17)]
    return _segment(0xC4, bytes([kind, *counts, *(s for _, s in order)]))


_TABLES = (
    _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    + _segment(0xDB, bytes([0, 8, *[1] * 63]))
    + _dht(0x00, _DC_ORDER)
    + _dht(0x10, [(1, 0)])
    + _segment(0xDD, WIDE.to_bytes(2, "big"))
)


def _header(rows: int) -> bytes:
    size = (8 * rows).to_bytes(2, "big") + (8 * WIDE).to_bytes(2, "big")
    return b"\xff\xd8" + _TABLES + _segment(0xC0, b"\x08" + size + b"\x01\x01\x11\x00") + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for a DC difference in -255..255, its end of block included."""
    code, bits = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        prefix, n = _DC_CODE[category]
        magnitude = d if d > 0 else d + (1 << category) - 1
        code[d + 255], bits[d + 255] = ((prefix << category) | (magnitude if category else 0)) << 1, n + category + 1
    return code, bits


_CODE, _BITS = _difference_codes()


def encode_batch(payloads: list[bytes]) -> list[bytes]:
    """The JPEG frames, back to back, that carry each payload (of a positive multiple of 192 bytes)."""
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDE).astype(np.int64)
    frames, owner = [], []
    for k, p in enumerate(payloads):
        n = len(p) // WIDE
        for at in range(0, n, TALL):
            frames.append(min(TALL, n - at))
            owner.append(k)
    heights = np.array(frames)
    ends = np.cumsum(heights)
    diff = np.empty_like(rows)
    diff[:, 0] = rows[:, 0] - 128
    np.subtract(rows[:, 1:], rows[:, :-1], out=diff[:, 1:])
    diff += 255
    nb = np.empty((len(rows), WIDE + 1), np.int64)
    code = np.empty((len(rows), WIDE + 1), np.uint64)
    nb[:, :WIDE], code[:, :WIDE] = _BITS[diff], _CODE[diff]
    cum = np.cumsum(nb[:, :WIDE], axis=1)
    row_bytes = (cum[:, -1] + 7) >> 3
    nb[:, WIDE] = row_bytes * 8 - cum[:, -1]  # a row is padded with ones to whole bytes
    code[:, WIDE] = (np.uint64(1) << nb[:, WIDE].astype(np.uint64)) - np.uint64(1)
    start = np.cumsum(row_bytes) - row_bytes
    at = np.empty_like(nb)
    at[:, 0], at[:, 1:] = 0, cum
    at += 8 * start[:, None]
    shift = (at & 31) + nb
    wide = ((code << (63 - shift).astype(np.uint64)) << np.uint64(1)).ravel()
    word = (at >> 5).ravel()
    total = int(row_bytes.sum())
    size = (total >> 2) + 3
    packed = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), size) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    data = packed.astype(np.uint32).astype(">u4").view(np.uint8)[:total]
    full = data == 0xFF
    stuffed = np.cumsum(full)
    of_row = np.repeat(np.arange(len(rows)), row_bytes)
    to = np.arange(total) + stuffed - full + 2 * of_row
    out = np.zeros(total + int(stuffed[-1]) + 2 * len(rows), np.uint8)
    out[to] = data
    row_end = to[np.cumsum(row_bytes) - 1] + 1 + full[np.cumsum(row_bytes) - 1]
    in_frame = np.arange(len(rows)) - np.repeat(ends - heights, heights)
    marker = 0xD0 + (in_frame & 7)
    marker[ends - 1] = 0xD9
    out[row_end], out[row_end + 1] = 0xFF, marker
    raw, cuts = out.tobytes(), [0, *(row_end[ends - 1] + 2).tolist()]
    media: list[list[bytes]] = [[] for _ in payloads]
    for k, n, i, j in zip(owner, frames, cuts, cuts[1:], strict=False):
        media[k] += [_header(n), raw[i:j]]
    return [b"".join(m) for m in media]


@dataclass
class Image:
    """What the markers of a baseline JPEG say, and where its scan of the first component lies."""

    width: int
    height: int
    #: (id, horizontal, vertical sampling, quantiser table)
    components: list[tuple[int, int, int, int]]
    #: first quantiser of each table, Huffman tables by class and slot
    quantisers: dict[int, int]
    huffman: dict[tuple[int, int], bytes]
    restart: int
    #: (index of component, DC slot, AC slot) of the scan that holds the first component
    scan: list[tuple[int, int, int]]
    data: bytes
    end: int = 0
    key: tuple = field(default=(), compare=False)


_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse(blob: bytes, at: int = 0) -> Image:
    """Parse one baseline JPEG at ``at``; ValueError if it is none."""
    if blob[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    at += 2
    frame: tuple | None = None
    quantisers: dict[int, int] = {}
    huffman: dict[tuple[int, int], bytes] = {}
    restart, found = 0, None
    while True:
        while blob[at : at + 2] == b"\xff\xff":
            at += 1
        if at + 2 > len(blob) or blob[at] != 0xFF:
            raise ValueError("truncated or broken marker")
        marker = blob[at + 1]
        if marker == 0xD9:
            break
        size = int.from_bytes(blob[at + 2 : at + 4], "big")
        body, at = blob[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                quantisers[body[i] & 15] = int.from_bytes(body[i + 1 : i + 2 + wide], "big")
                i += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                n = 17 + sum(body[i + 1 : i + 17])
                huffman[body[i] >> 4, body[i] & 15] = body[i + 1 : i + n]
                i += n
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only 8-bit samples are baseline")
            frame = (int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)])
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if not frame:
                raise ValueError("scan before frame")
            ids = [c[0] for c in frame[2]]
            scan = [(ids.index(body[k]), body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)]
            m = _NEXT.search(blob, at)
            if not m:
                raise ValueError("unended scan")
            if not found and any(c == 0 for c, _, _ in scan):
                used = {(kind, s[1 + kind]) for s in scan for kind in (0, 1)}
                found = (scan, blob[at : m.start()], restart, {k: huffman[k] for k in used})
            at = m.start()
    if not frame or not found or not frame[0] or not frame[1]:
        raise ValueError("no scan of the first component")
    w, h, comps = frame
    scan, data, restart, tables = found
    image = Image(w, h, comps, quantisers, tables, restart, scan, data, at + 2)
    image.key = (tuple(comps), quantisers[comps[0][3]], tuple(sorted(tables.items())), restart, tuple(scan))
    return image


_luts: dict[bytes, np.ndarray] = {}


def _lut(table: bytes) -> np.ndarray:
    """For each 16-bit prefix: length * 256 + symbol; 0 where there is no code."""
    if table not in _luts:
        lut, code, at = np.zeros(65536, np.int64), 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                lut[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[at]
                code, at = code + 1, at + 1
            code <<= 1
        _luts[table] = lut
    return _luts[table]


_HALF = np.array([0] + [1 << (k - 1) for k in range(1, 17)], np.int64)
_OFF = np.array([(1 << k) - 1 for k in range(17)], np.int64)
_U = np.uint64


def _layout(image: Image) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """Blocks of an MCU as (component, DC slot, AC slot, row, column), MCUs across and down."""
    hmax, vmax = max(c[1] for c in image.components), max(c[2] for c in image.components)
    if len(image.scan) == 1:
        c, dc, ac = image.scan[0]
        _, h, v, _ = image.components[c]
        across, down = -(-(-(-image.width * h // hmax)) // 8), -(-(-(-image.height * v // vmax)) // 8)
        return [(c, dc, ac, 0, 0)], across, down
    blocks = [(c, dc, ac, y, x) for c, dc, ac in image.scan for y in range(image.components[c][2]) for x in range(image.components[c][1])]
    return blocks, -(-image.width // (8 * hmax)), -(-image.height // (8 * vmax))


def _decode_group(images: list[Image]) -> list[np.ndarray]:
    """Thumbnails of images that share tables, sampling and restart interval."""
    layouts = [_layout(i) for i in images]
    blocks = layouts[0][0]
    mcus = np.array([a * d for _, a, d in layouts])
    raw = np.frombuffer(b"".join(i.data for i in images), np.uint8)
    begins = np.cumsum([0, *(len(i.data) for i in images)])[:-1]
    keep = np.ones(len(raw), bool)
    ff = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, np.int64)
    after = raw[ff + 1] if len(ff) else raw[:0]
    keep[ff[after == 0] + 1] = False
    keep[ff[after == 0xFF]] = False
    restarts = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[restarts] = keep[restarts + 1] = False
    starts = np.concatenate([begins, restarts + 2])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    place = np.concatenate([[0], np.cumsum(keep)])
    first_bit = 8 * place[starts]
    owner = np.searchsorted(begins, starts, side="right") - 1
    index = np.arange(len(starts)) - np.searchsorted(owner, np.arange(len(images)))[owner]
    interval = images[0].restart
    first_mcu = index * interval if interval else np.zeros(len(starts), np.int64)
    count = np.minimum(mcus[owner] - first_mcu, interval or mcus.max())
    if (count <= 0).any() or (np.bincount(owner, count, len(images)) != mcus).any():
        raise ValueError("restart intervals do not cover the image")
    data = np.concatenate([raw[keep], np.full(9, 0xFF, np.uint8)])
    n = len(data) - 8
    window = np.zeros(n, _U)
    for k in range(8):
        window |= data[k : k + n].astype(_U) << _U(56 - 8 * k)
    lanes = np.argsort(-count, kind="stable")  # lanes that end early leave at the back
    bit, left = first_bit[lanes].copy(), count[lanes]
    pred = {c: np.zeros(len(lanes), np.int64) for c, _, _ in images[0].scan}
    mine = [k for k, b in enumerate(blocks) if b[0] == 0]
    out = np.zeros((len(lanes), int(count.max()), len(mine)), np.int16)
    limit = n - 1
    for step in range(int(count.max())):
        live = int(np.searchsorted(-left, -step, side="left"))
        for k, (c, dc, ac, _, _) in enumerate(blocks):
            at = bit[:live]
            x = window[np.minimum(at >> 3, limit)] << (at & 7).astype(_U)
            e = _lut(images[0].huffman[0, dc])[(x >> _U(48)).astype(np.int64)]
            if not e.all():
                raise ValueError("no such Huffman code")
            size, length = e & 255, e >> 8
            x = x << length.astype(_U)
            value = ((x >> _U(1)) >> (63 - size).astype(_U)).astype(np.int64)
            value -= np.where(value < _HALF[size], _OFF[size], 0)
            p = pred[c][:live]
            p += value
            if c == 0:
                out[:live, step, mine.index(k)] = p
            at = at + length + size
            x = x << size.astype(_U)  # the first AC code still lies in the window
            lut = _lut(images[0].huffman[1, ac])
            e = lut[(x >> _U(48)).astype(np.int64)]
            at = at + (e >> 8)
            if (e & 255).any() or not e.all():
                at = _skip_ac(at, e, lut, window, limit)
            bit[:live] = at
    quantiser, thumbs = images[0].quantisers[images[0].components[0][3]], []
    pixel = np.clip((out.astype(np.int32) * quantiser + 4 >> 3) + 128, 0, 255).astype(np.uint8)
    back = np.empty(len(lanes), np.int64)
    back[lanes] = np.arange(len(lanes))
    where = np.searchsorted(owner, np.arange(len(images) + 1))
    hs, vs = images[0].components[0][1:3]
    hmax, vmax = max(c[1] for c in images[0].components), max(c[2] for c in images[0].components)
    for k, (image, (_, across, down)) in enumerate(zip(images, layouts, strict=True)):
        own = back[where[k] : where[k + 1]]
        if (count[where[k] : where[k + 1]] == out.shape[1]).all():
            flat = pixel[own].reshape(-1, len(mine))
        else:
            flat = np.concatenate([pixel[i, : left[i]] for i in own])
        if len(mine) == 1:
            grid = flat.reshape(down, across)
        else:
            grid = flat.reshape(down, across, vs, hs).transpose(0, 2, 1, 3).reshape(down * vs, across * hs)
        thumbs.append(grid[: -(-(-(-image.height * vs // vmax)) // 8), : -(-(-(-image.width * hs // hmax)) // 8)])
    return thumbs


def _skip_ac(at: np.ndarray, e: np.ndarray, lut: np.ndarray, window: np.ndarray, limit: int) -> np.ndarray:
    """Bit positions after the blocks whose first AC entries are ``e``, already consumed but for magnitudes."""
    at, k = at.copy(), np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while True:
        if not e.all():
            raise ValueError("no such Huffman code")
        symbol = e & 255
        k[live] += np.where(symbol == 0, 64, (symbol >> 4) + 1)
        at[live] += symbol & 15
        live = live[k[live] < 63]
        if not len(live):
            return at
        x = window[np.minimum(at[live] >> 3, limit)] << (at[live] & 7).astype(_U)
        e = lut[(x >> _U(48)).astype(np.int64)]
        at[live] += e >> 8


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """DC-only luminance thumbnails (uint8, an eighth of the size), in order."""
    groups: dict[tuple, list[int]] = {}
    for k, image in enumerate(images):
        groups.setdefault(image.key, []).append(k)
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(images)
    for members in groups.values():
        for k, thumb in zip(members, _decode_group([images[k] for k in members]), strict=True):
            out[k] = thumb
    return out


def parse_all(blob: bytes) -> list[Image]:
    """The frames of a blob that holds JPEG images back to back."""
    at, out = 0, []
    while at < len(blob):
        out.append(parse(blob, at))
        at = out[-1].end
    return out


def hashes(thumb: np.ndarray) -> tuple[int, int]:
    """Average hash and difference hash, 64 bits each, of a thumbnail of any size."""
    h, w = thumb.shape
    ys, xs = np.arange(8) * h // 8, np.arange(9) * w // 9
    sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), ys, axis=0), xs, axis=1)
    area = np.maximum(np.diff([*ys, h]), 1)[:, None] * np.maximum(np.diff([*xs, w]), 1)[None, :]
    cells = sums / area
    bits = np.packbits(np.concatenate([(cells[:, :8] > cells[:, :8].mean()).ravel(), (cells[:, 1:] > cells[:, :-1]).ravel()]))
    return int.from_bytes(bits[:8].tobytes(), "big"), int.from_bytes(bits[8:].tobytes(), "big")


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(text: bytes) -> bytes:
    """Spaces up to a positive multiple of the unit."""
    return text + b" " * (-len(text) % UNIT) if text else b" " * UNIT


def _rows(ids: list, texts: list[bytes]) -> pa.RecordBatch:
    payloads = [pad(t) for t in texts]
    media = encode_batch(payloads)
    parsed = [parse_all(m) for m in media]
    thumbs = iter(thumbnails([i for images in parsed for i in images]))
    rows = []
    for doc, text, m, images in zip(ids, texts, media, parsed, strict=True):
        own = [next(thumbs) for _ in images]
        image = own[0] if len(own) == 1 else np.concatenate(own)
        read = image.tobytes()
        a, d = hashes(image)
        size = f"{images[0].width}x{sum(i.height for i in images)}"
        rows.append((doc, len(text), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]), len(m), hashlib.sha256(m).hexdigest(), f"{size}:{a:016x}:{d:016x}"))
    names = [x.split()[0] for x in STORED.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in STORED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, held = [], [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc)
            texts.append(text)
            held += len(text) + UNIT
            if held >= BATCH:
                yield _rows(ids, texts)
                ids, texts, held = [], [], 0
        if ids:
            yield _rows(ids, texts)


def store_as_jpeg(docs: DataFrame) -> DataFrame:
    """Each text of ``docs(doc_id, text, ...)`` stored in JPEG frames, read back and hashed.

    Null and empty texts become 192 spaces; texts above half a megabyte take several
    frames; equal texts give equal values; a null doc_id stays null; repeated rows
    stay repeated; other columns are ignored. ``feature`` is
    ``<width>x<height>:<average hash>:<difference hash>`` of the thumbnail.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(_store, STORED)


IMAGE = "width int, height int, thumbnail_width int, thumbnail_height int, thumbnail binary, average_hash long, difference_hash long, error string"


def _describe(key: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                blob, found = batch.column(1)[row].as_py(), {"error": None}
                try:
                    image = parse(blob or b"")
                    thumb = thumbnails([image])[0]
                    signed = [x - (1 << 64) if x >> 63 else x for x in hashes(thumb)]
                    found |= {"width": image.width, "height": image.height, "thumbnail_width": thumb.shape[1], "thumbnail_height": thumb.shape[0], "thumbnail": thumb.tobytes(), "average_hash": signed[0], "difference_hash": signed[1]}
                except (ValueError, IndexError, KeyError) as e:
                    found["error"] = str(e) or type(e).__name__
                kinds = {"thumbnail": pa.binary(), "error": pa.string(), "average_hash": pa.int64(), "difference_hash": pa.int64()}
                names = [x.split()[0] for x in IMAGE.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), *(pa.array([found.get(n)], kinds.get(n, pa.int32())) for n in names)], names=[key, *names])

    return rows


def describe(images: DataFrame, key: str, content: str = "content") -> DataFrame:
    """Dimensions, DC-only thumbnail and its hashes of a column of JPEG images.

    One row per input row; what is no baseline JPEG (null included) has an ``error``
    and nulls elsewhere.
    """
    prepare(images.sparkSession)
    kind = images.schema[key].dataType.simpleString()
    return images.select(key, F.col(content).cast("binary").alias("content")).mapInArrow(_describe(key), f"`{key}` {kind}, {IMAGE}")
