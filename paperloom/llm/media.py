"""PNG images in binary columns and low-frequency cosine-transform hashes.

An image is stored as a greyscale PNG of 8-bit samples: signature, IHDR, IDAT chunks of a zlib stream of
filtered rows, IEND, each with its CRC-32. Reading checks every checksum and undoes the row filters, those that add
the sample before or above with array operations, the other two sample by sample (the writer uses neither). The perceptual hash shrinks the image to 32 x 32 by area means and compares the lowest
frequencies of its cosine transform with their median.

Defined cases: a null or empty payload is one row of zeros; equal payloads, repeated rows too, give equal bytes and
hashes; nothing is compared, so there are no ties; a very long payload is one image, held by its task with some five
times its size; rows are taken ROWS at a time, so that a batch's images never stand in memory together; damaged PNGs raise ValueError with the reason; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import text_or_empty

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
CHUNK = 1 << 16
SIDE, LOW = 32, 8
#: Rows whose images a task holds at once.
ROWS = 64


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _filtered(image: np.ndarray) -> np.ndarray:
    """Rows after the filter (left or up) that leaves the least sum of signed differences, if under a quarter of the samples' own: text packs better as it is."""
    wide = image.astype(np.int16)
    left, up = wide.copy(), wide.copy()
    left[:, 1:] -= wide[:, :-1]
    up[1:] -= wide[:-1]
    each = np.stack([image, left.astype(np.uint8), up.astype(np.uint8)])
    cost = np.minimum(each, 256 - each.astype(np.int16)).sum(axis=2, dtype=np.int64)
    cost[1:] *= 4
    best = cost.argmin(axis=0)
    out = np.empty((len(image), image.shape[1] + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = np.take_along_axis(each, best[None, :, None], axis=0)[0]
    return out


def encode_png(image: np.ndarray, level: int = 6) -> bytes:
    """A two-dimensional array of 8-bit samples as PNG."""
    height, width = image.shape
    stream = zlib.compress(_filtered(image).tobytes(), level)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
    return SIGNATURE + head + b"".join(_chunk(b"IDAT", stream[k : k + CHUNK]) for k in range(0, len(stream), CHUNK)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray) -> np.ndarray:
    """Undo the row filters 0 to 4. Runs of rows of one simple filter are undone at once."""
    kind, out = rows[:, 0], rows[:, 1:].copy()
    if kind.size and kind.max() > 4:
        raise ValueError("PNG: unknown row filter")
    left = kind == 1
    out[left] = np.cumsum(out[left], axis=1, dtype=np.uint8)
    turns = np.flatnonzero(np.diff(kind)) + 1
    for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(kind)], strict=True):
        if a == b or kind[a] < 2:
            continue
        if kind[a] == 2:
            first = max(a - 1, 0)
            out[first:b] = np.cumsum(out[first:b], axis=0, dtype=np.uint8)
            continue
        for y in range(a, b):
            above = out[y - 1].astype(int).tolist() if y else [0] * out.shape[1]
            out[y] = _average(out[y].tolist(), above) if kind[y] == 3 else _paeth(out[y].tolist(), above)
    return out


def _average(row: list[int], above: list[int]) -> list[int]:
    last, out = 0, []
    for x, b in zip(row, above, strict=True):
        last = (x + (last + b) // 2) & 255
        out.append(last)
    return out


def _paeth(row: list[int], above: list[int]) -> list[int]:
    a, c, out = 0, 0, []
    for x, b in zip(row, above, strict=True):
        p = a + b - c
        pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
        a = (x + (a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c)) & 255
        c = b
        out.append(a)
    return out


def decode_png(data: bytes) -> np.ndarray:
    """The samples of a greyscale 8-bit PNG without interlace; checks signature, checksums, order and sizes."""
    if data[:8] != SIGNATURE:
        raise ValueError("PNG: bad signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(data):
        if ended or len(data) < at + 12:
            raise ValueError("PNG: bad length")
        size = int.from_bytes(data[at : at + 4], "big")
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("PNG: bad checksum")
        if head is None and kind != b"IHDR":
            raise ValueError("PNG: no header")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not ended:
        raise ValueError("PNG: no end")
    width, height, *rest = head
    if rest != [8, 0, 0, 0, 0]:
        raise ValueError("PNG: only greyscale of 8 bits without interlace")
    raw = zlib.decompress(b"".join(parts))
    if len(raw) != height * (width + 1):
        raise ValueError("PNG: bad size")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(LOW)[:, None], np.arange(SIDE)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * SIDE))


def _shrink(image: np.ndarray) -> np.ndarray:
    """Means over a SIDE x SIDE grid; a short side repeats its rows."""
    for _ in range(2):
        n = len(image)
        edge = np.arange(SIDE) * n // SIDE
        size = np.maximum(np.append(edge[1:], n) - edge, 1)
        image = np.add.reduceat(image, edge, axis=0, dtype=np.int64) if n >= SIDE else image[edge]
        image = (image / (size[:, None] if n >= SIDE else 1)).T
    return image


def cosine_hash(image: np.ndarray) -> int:
    """64 bits: lowest 8 x 8 frequencies over their median without the constant term."""
    c = _cosines()
    low = np.round(c @ _shrink(image) @ c.T, 6).ravel()
    return int.from_bytes(np.packbits(low > np.median(low[1:])).tobytes(), "big")


def as_image(payload: bytes) -> np.ndarray:
    """A payload as rows of WIDTH samples, with zeros to fill the last of at least one row."""
    rows = max(1, -(-len(payload) // WIDTH))
    return np.frombuffer(payload.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)


def _few(batches):
    for batch in batches:
        yield from (batch.slice(k, ROWS) for k in range(0, batch.num_rows, ROWS))


def to_png(df: DataFrame, payload: str = "payload", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, n_bytes and media: each binary payload as PNG."""

    def run(batches):
        for batch in _few(batches):
            data = [x.as_buffer().to_pybytes() for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(x) for x in data], pa.int64()), pa.array([encode_png(as_image(x)) for x in data], pa.binary())], [*keys, "n_bytes", "media"])

    rows = df.select(*keys, text_or_empty(payload).cast("binary").alias("__payload"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, n_bytes long, media binary")


def png_features(media: DataFrame, keys: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """keys, digests of what is read back from media, and its cosine hash as 16 hex digits."""

    def run(batches):
        for batch in _few(batches):
            out = []
            for x in batch.column(batch.num_columns - 1):
                stored = x.as_buffer().to_pybytes()
                image = decode_png(stored)
                payload = image.tobytes()
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{cosine_hash(image):016x}"))
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [*keys, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    rows = media.select(*keys, "media")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return png_features(to_png(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text"))
