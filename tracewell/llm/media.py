"""Media columns: Netpbm and BMP images as bytes, decoded to numpy, resized, hashed.

``encode`` stores a payload of whole ``24 x 24`` blocks without loss as the
samples of an image 24 samples wide: binary PGM (P5), binary PPM (P6, eight
pixels a row) or bottom-up BMP with 8 or 24 bits a pixel, chosen by the
payload's own checksum, so equal payloads are stored alike.  ``decode`` reads
any Netpbm image (P1 to P6, 8 or 16 bit, brought to the full range) or uncompressed
8/16/24/32-bit BMP, with or without masks, into an array.

Features come from area resizing by integral images: the image's running sums
are read at the (fractional) corners of each target cell, so a cell is the exact
mean of the area below it. A 9 x 8 resize gives the 64-bit difference hash (is a
cell brighter than its left neighbour), a 16 x 16 resize is kept as an NPY tile.

Edge cases: null texts are empty ones; the empty payload is one padding block;
bytes that are no image decode to None and give null features; repeated rows
are stored and hashed one by one.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WIDTH, BLOCK, PAD = 24, 576, 255
TILE = 16
#: Rows of an image that are summed as longs at a time.
ROWS_AT_ONCE = 1 << 12
#: Bytes of text that a task encodes before it hands on a batch.
BATCH_BYTES = 8 << 20


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(padded payload, bytes of the text)."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    return data + bytes([PAD]) * (max(BLOCK, -(-n // BLOCK) * BLOCK) - n), n


def encode(payload: bytes) -> bytes:
    kind = zlib.crc32(payload) % 4
    h = len(payload) // WIDTH
    if kind == 0:
        return b"P5\n%d %d\n255\n" % (WIDTH, h) + payload
    if kind == 1:
        return b"P6\n%d %d\n255\n" % (WIDTH // 3, h) + payload
    rows = np.frombuffer(payload, np.uint8).reshape(h, WIDTH)[::-1]
    if kind == 2:  # 24 samples are a multiple of four: rows need no padding
        palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
        palette[:, 3] = 0
        head, bits, w = palette.tobytes(), 8, WIDTH
    else:
        rows = rows.reshape(h, WIDTH // 3, 3)[:, :, ::-1]
        head, bits, w = b"", 24, WIDTH // 3
    at = 54 + len(head)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, len(payload), 2835, 2835, 256 if head else 0, 0)
    return struct.pack("<2sIHHI", b"BM", at + len(payload), 0, 0, at) + info + head + np.ascontiguousarray(rows).tobytes()


def decode(media: bytes | None) -> np.ndarray | None:
    """The samples as (height, width) or (height, width, 3); None for what is no such image."""
    try:
        if media[:2] == b"BM":
            return _bmp(media)
        return _netpbm(media)
    except (TypeError, ValueError, IndexError, ZeroDivisionError, struct.error):
        return None


def _netpbm(media: bytes) -> np.ndarray | None:
    blank = rb"(?:\s|#[^\n]*\n)+(\d+)"
    m = re.match(rb"P([1-6])" + blank * 2, media)
    if not m:
        return None
    kind, w, h = int(m[1]), int(m[2]), int(m[3])
    if kind in (1, 4):  # bits: one is black
        if kind == 1:
            bits = np.array([c - 48 for c in re.sub(rb"#[^\n]*", b"", media[m.end() :]) if c in b"01"][: w * h], np.uint8)
        else:
            stride = -(-w // 8)
            bits = np.unpackbits(np.frombuffer(media, np.uint8, stride * h, m.end() + 1).reshape(h, stride), axis=1)[:, :w]
        return (1 - bits.reshape(h, w)) * np.uint8(255)
    m = re.match(rb"P[2356]" + blank * 3 + rb"\s", media)
    if not m or not 0 < int(m[3]) < 65536:
        return None
    top, shape = int(m[3]), (h, w, 3) if kind in (3, 6) else (h, w)
    n = int(np.prod(shape))
    most, plain = (255, np.uint8) if top < 256 else (65535, np.uint16)
    samples = np.array(media[m.end() :].split()[:n], np.int64).reshape(shape) if kind < 4 else np.frombuffer(media, np.uint8 if top < 256 else ">u2", n, m.end()).reshape(shape)
    if top == most:
        return samples.astype(plain) if kind < 4 else samples
    return ((samples.astype(np.int64) * most + top // 2) // top).astype(plain)  # brought to the full range


def _bmp(media: bytes) -> np.ndarray | None:
    at, head, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", media, 10)
    if packed not in (0, 3) or bits not in (8, 16, 24, 32) or head < 40:
        return None
    stride = -(-w * bits // 32) * 4
    rows = np.frombuffer(media, np.uint8, stride * abs(h), at).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        start = 14 + head  # the palette follows the header, whatever its version
        colours = min(256, (at - start) // 4)
        palette = np.frombuffer(media, np.uint8, 4 * colours, start).reshape(colours, 4)[:, 2::-1]
        rgb = palette[rows[:, :w]]
        return rgb[:, :, 0] if (palette == palette[:, :1]).all() else rgb
    if bits == 16 or packed == 3:  # masks stand where the header would go on
        masks = struct.unpack_from("<III", media, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)
        pixels = np.ascontiguousarray(rows[:, : w * bits // 8]).view(f"<u{bits // 8}").astype(np.int64)
        parts = [(pixels & m) >> ((m & -m).bit_length() - 1) for m in masks]
        tops = [m >> ((m & -m).bit_length() - 1) for m in masks]
        return np.stack([(x * 255 + t // 2) // t for x, t in zip(parts, tops)], 2).astype(np.uint8)
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def area_resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means of the areas below a height x width grid, as floats.

    Of the integral image only the rows next to the grid's lines are kept, so memory does not grow with the height.
    """
    h, w = image.shape[:2]
    y = np.linspace(0, h, height + 1)
    low = np.minimum(y.astype(np.int64), h - 1)
    wanted = np.unique(np.concatenate((low, low + 1)))  # sums of all rows above these
    # sums between the wanted rows, whole numbers, some rows at a time; the last wanted row is the image's end
    ends = wanted[wanted > 0]
    runs = np.zeros((len(ends), *image.shape[1:]), np.int64)
    for a in range(0, h, ROWS_AT_ONCE):
        part = image[a : a + ROWS_AT_ONCE]
        starts = np.concatenate(([0], ends[(ends > a) & (ends < a + len(part))] - a))
        first = np.searchsorted(ends, a, "right")
        runs[first : first + len(starts)] += np.add.reduceat(part, starts, axis=0, dtype=np.int64)
    runs = runs.sum(2) / runs.shape[2] if runs.ndim == 3 else runs.astype(np.float64)
    sums = np.zeros((len(wanted), w + 1))
    sums[len(wanted) - len(ends) :, 1:] = runs.cumsum(0).cumsum(1)

    def between(lines: np.ndarray, low: np.ndarray, table: np.ndarray, place: np.ndarray) -> np.ndarray:
        f = (lines - low)[:, None]
        return table[place] * (1 - f) + table[place + 1] * f

    rows = between(y, low, sums, np.searchsorted(wanted, low))
    x = np.linspace(0, w, width + 1)
    left = np.minimum(x.astype(np.int64), w - 1)
    corners = between(x, left, rows.T, left).T
    area = (h / height) * (w / width)
    return (corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]) / area


def difference_hash(image: np.ndarray) -> int:
    """64 bits, row by row: is a cell of the 9 x 8 resize brighter than the one on its left (by more than rounding)."""
    small = area_resize(image, 9, 8)
    return int(np.packbits((small[:, 1:] - small[:, :-1] > 1e-9).ravel()).view(">u8")[0])


def npy_tile(image: np.ndarray, side: int = TILE) -> bytes:
    """The side x side resize as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(image, side, side)).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def stored(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, text -> doc_id, n_bytes, media (the image file's bytes)."""

    def run(batches):
        names = ["doc_id", "n_bytes", "media"]
        kinds = [pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            rows, size = [], 0
            for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                payload, n = payload_of(text.as_py())
                rows.append((doc_id.as_py(), n, encode(payload)))
                size += len(payload)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"


def features(media: DataFrame) -> DataFrame:
    """``media``: doc_id, n_bytes, media -> digests of the decoded samples, difference hash and NPY tile."""

    def one(doc_id, n, data):
        image = decode(data)
        if image is None:
            return doc_id, n, None, None, None, len(data) if data is not None else None, hashlib.sha256(data).hexdigest() if data is not None else None, None, None
        payload = np.ascontiguousarray(image).tobytes()
        return (
            doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data),
            hashlib.sha256(data).hexdigest(), f"{difference_hash(image):016x}", npy_tile(image),
        )

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for b in batches:
            rows = [one(*(x.as_py() for x in r)) for r in zip(b.column("doc_id"), b.column("n_bytes"), b.column("media"))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return media.mapInArrow(run, FEATURES)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text as an image in a table of the shared folder, read it back and compute its features."""
    return features(materialize(stored(docs), "media"))
