"""Media columns: PNG images in binary columns, written and read with zlib and numpy, and cosine-transform hashes.

A payload becomes an 8-bit greyscale image of fixed width; the decoder checks signature, chunk lengths and
checksums, undoes all five PNG filters and returns the samples, from which the low-frequency hash is taken.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import spread

from .common import mapped, named, table, wider

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK = 1 << 16
#: Fixed values of the PNG format: samples a pixel by colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def chosen_filters(rows: np.ndarray, c: int = 1) -> np.ndarray:
    """For each row none (0), left (1) or up (2): the one whose residues, as signed bytes, have the smallest absolute sum."""
    left, up = rows.copy(), rows.copy()
    left[:, c:] -= rows[:, :-c]
    up[1:] -= rows[:-1]
    sums = [np.abs(x.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64) for x in (rows, left, up)]
    return np.argmin(sums, axis=0).astype(np.uint8)


def png_encode(samples: np.ndarray, filters: int | np.ndarray | None = None, level: int = 6) -> bytes:
    """PNG bytes of (height, width) or (height, width, channels) uint8 samples; ``filters`` holds 0 to 4, one or by row,
    or is chosen by row."""
    h, w = samples.shape[:2]
    c = samples.shape[2] if samples.ndim == 3 else 1
    rows = np.ascontiguousarray(samples).reshape(h, w * c)
    filters = chosen_filters(rows, c) if filters is None else filters
    kinds = np.broadcast_to(np.asarray(filters, dtype=np.uint8), (h,))
    raw = np.empty((h, w * c + 1), dtype=np.uint8)
    raw[:, 0] = kinds
    raw[:, 1:] = rows
    if kinds.any():
        left, up, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
        left[:, c:] = rows[:, :-c]
        up[1:] = rows[:-1]
        corner[1:, c:] = rows[:-1, :-c]
        for kind in np.unique(kinds[kinds > 0]):
            at = kinds == kind
            raw[at, 1:] = rows[at] - _predict(int(kind), left[at], up[at], corner[at])
    colour = {n: t for t, n in CHANNELS.items()}[c]
    body = zlib.compress(raw.tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0))]
    parts += [_chunk(b"IDAT", body[i : i + CHUNK]) for i in range(0, len(body), CHUNK)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _predict(kind: int, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The PNG predictors 1 to 4 for samples whose three neighbours are known."""
    if kind == 1:
        return left
    if kind == 2:
        return up
    a, b, c = left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)
    if kind == 3:
        return ((a + b) // 2).astype(np.uint8)
    p = a + b - c
    da, db, dc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c)).astype(np.uint8)


def png_decode(data: bytes) -> np.ndarray:
    """Samples of an 8-bit, non-interlaced PNG; ValueError where a checksum, length or field is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG signature")
    at, head, body, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise ValueError("truncated chunk")
        (n,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(content) != n or at + 12 + n > len(data):
            raise ValueError("truncated chunk")
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(content, zlib.crc32(kind)):
            raise ValueError(f"checksum of {kind!r} is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("IHDR or IEND is missing")
    w, h, depth, colour, _, _, interlace = head
    if depth != 8 or colour not in CHANNELS or interlace:
        raise ValueError("only 8-bit samples without a palette or interlace are read")
    c = CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    if raw.size != h * (w * c + 1):
        raise ValueError("sample data have the wrong length")
    rows = _unfilter(raw.reshape(h, w * c + 1), c)
    return rows if c == 1 else rows.reshape(h, w, c)


def _unfilter(raw: np.ndarray, c: int) -> np.ndarray:
    """Samples of filtered rows.

    Without average and Paeth rows: sums along the left-filtered rows, then sums down each run of up-filtered ones. With
    them, pixels that stand on one anti-diagonal need only those of the two before it, so each is undone at once.
    """
    kinds, out = raw[:, 0], raw[:, 1:].copy()
    if not kinds.any():
        return out
    if kinds.max() > 4:
        raise ValueError("unknown filter")
    h, n = out.shape
    if kinds.max() <= 2:
        left, up = kinds == 1, kinds == 2
        if left.any():
            out[left] = np.cumsum(out[left].reshape(-1, n // c, c), axis=1, dtype=np.uint8).reshape(-1, n)
        if up.any():
            # Sums modulo 256 down the whole column; what they were at a run's start is taken back.
            sums = np.cumsum(np.where(up[:, None], out, 0), axis=0, dtype=np.uint8)
            base = np.maximum.accumulate(np.where(up, -1, np.arange(h)))
            start = np.where((base >= 0)[:, None], out[base] - sums[base], 0).astype(np.uint8)
            out = np.where(up[:, None], start + sums, out)
        return out
    grid = np.zeros((h + 1, n // c + 1, c), dtype=np.uint8)
    grid[1:, 1:] = out.reshape(h, n // c, c)
    for d in range(h + n // c - 1):
        y = np.arange(max(0, d - n // c + 1), min(h, d + 1))
        x = d - y
        left, up, corner, kind = grid[y + 1, x], grid[y, x + 1], grid[y, x], kinds[y]
        for k in range(1, 5):
            at = np.flatnonzero(kind == k)
            if len(at):
                grid[y[at] + 1, x[at] + 1] += _predict(k, left[at], up[at], corner[at])
    return grid[1:, 1:].reshape(h, n)


def _basis(size: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(size)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * size))


SIDE, LOW = 32, 8
BASIS = _basis(SIDE, LOW)


def cosine_hash(grey: np.ndarray) -> str:
    """16 hex digits: signs of the 8 x 8 lowest cosine terms against their median, of the image shrunk to 32 x 32.

    Shrinking takes means over equal bands; a side shorter than 32 repeats its lines.
    """
    small = grey
    for axis in (0, 1):
        n = small.shape[axis]
        edges = np.arange(SIDE + 1) * n // SIDE
        if n >= SIDE:
            sums = np.add.reduceat(small, edges[:-1], axis=axis, dtype=np.float64)
            widths = np.diff(edges)
            small = sums / (widths[:, None] if axis == 0 else widths)
        else:
            small = np.take(small, edges[:-1], axis=axis)
    terms = (BASIS @ small.astype(np.float64) @ BASIS.T).round(6).ravel()
    return np.packbits(terms > np.median(terms[1:])).tobytes().hex()


def to_png(df: DataFrame, text: str = "text", media: str = "media", width: int = WIDTH, level: int = 6) -> DataFrame:
    """``df`` without its text but with ``media``: the text's UTF-8 bytes, zero-filled to whole rows, as a PNG.

    Each row is filtered by none, left or up. Null and empty texts make one row of zeros, repeated rows and equal texts
    give equal images, other columns stay as they are, an empty table gives an empty one. Runs in place, batch by batch,
    without a shuffle.
    """
    rest = [c for c in df.columns if c not in (text, media)]
    src = df.select(*[named(c) for c in rest], F.coalesce(named(text).cast("binary"), F.lit(b"")).alias(media))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(media)
            out = []
            for value in batch.column(at):
                data = value.as_py()
                data += b"\0" * (-len(data) % width or (0 if data else width))
                out.append(png_encode(np.frombuffer(data, dtype=np.uint8).reshape(-1, width), level=level))
            yield batch.set_column(at, media, pa.array(out, type=pa.binary()))

    return mapped(src, encode, src.schema)


FEATURES = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "feature": "string"}


def png_features(df: DataFrame, media: str = "media", tail: int = 64) -> DataFrame:
    """``df`` with what is read back from the stored images: size and SHA-256 of the samples, CRC-32 of the last
    ``tail`` of them, and the cosine hash. A null image gives nulls; a damaged one fails the task. Columns of these
    names must not be there before; repeated rows get equal values."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sha, crc, feature = [], [], [], []
            for value in batch.column(batch.schema.get_field_index(media)):
                data = value.as_py()
                grey = None if data is None else png_decode(data)
                payload = b"" if grey is None else grey.tobytes()
                size.append(None if grey is None else len(payload))
                sha.append(None if grey is None else hashlib.sha256(payload).hexdigest())
                crc.append(None if grey is None else zlib.crc32(payload[-tail:]))
                feature.append(None if grey is None else cosine_hash(grey))
            columns = [*batch.columns, pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64()), pa.array(feature, pa.string())]
            names = [*batch.schema.names, *FEATURES]
            yield pa.RecordBatch.from_arrays(columns, names)

    return mapped(df, decode, wider(df.schema, **FEATURES))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored image, read back and digested."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return png_features(to_png(docs)).select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
