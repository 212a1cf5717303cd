"""Media columns: lossless PNG images in binary columns, and their visual hashes.

A payload of bytes becomes an 8-bit RGB image of 64 pixels a row (192 bytes),
is stored as PNG (zlib stream in checksummed chunks), and is read back by a
decoder that tests every checksum and undoes the row filters with numpy.
Features are signs of low-frequency cosine-transform coefficients.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandline.llm._common import gives_back, pick, steps, table

PIXELS = 64
CHANNELS = 3
ROW_BYTES = PIXELS * CHANNELS
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_CHUNK_BYTES = 1 << 16
_SIDE = 32
_LOW = 8
_ZLIB_LEVEL = 3


# ---------------------------------------------------------------- container


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def pad(data: bytes) -> bytes:
    """Fill with spaces to a positive multiple of a row."""
    short = -len(data) % ROW_BYTES if data else ROW_BYTES
    return data + b" " * short


def _filtered(rows: np.ndarray) -> np.ndarray:
    """Each row behind its filter byte; None, Sub or Up, whichever leaves least."""
    sub = rows.copy()
    sub[:, CHANNELS:] -= rows[:, :-CHANNELS]
    up = rows.copy()
    up[1:] -= rows[:-1]
    kinds = np.stack([rows, sub, up])
    cost = np.abs(kinds.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    out = np.empty((len(rows), ROW_BYTES + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = kinds[best, np.arange(len(rows))]
    return out


def encode_png(payload: bytes) -> bytes:
    """A PNG whose samples are the payload, which must fill whole rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES)
    stream = zlib.compress(_filtered(rows).tobytes(), _ZLIB_LEVEL)
    parts = [_SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", PIXELS, len(rows), 8, 2, 0, 0, 0))]
    parts += [_chunk(b"IDAT", stream[i : i + _CHUNK_BYTES]) for i in range(0, len(stream), _CHUNK_BYTES)]
    parts.append(_chunk(b"IEND", b""))
    return b"".join(parts)


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG: wrong signature")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("truncated PNG chunk")
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of chunk {kind!r} does not match")
        yield kind, body
        at += 12 + size


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    p = a + b - c
    pa_, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - c)
    return np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))


def _unfilter(kinds: np.ndarray, rows: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the row filters; rows of None, Sub and Up all at once."""
    height, width = rows.shape
    across = np.where((kinds == 1)[:, None, None], np.cumsum(rows.reshape(height, -1, bpp), axis=1, dtype=np.uint8), rows.reshape(height, -1, bpp))
    out = across.reshape(height, width)
    if not np.isin(kinds, (3, 4)).any():
        down = np.cumsum(out, axis=0, dtype=np.uint8)
        # An Up row adds to the row above it: sums restart at the last other row.
        start = np.maximum.accumulate(np.where(kinds == 2, 0, np.arange(height)))
        before = np.zeros_like(down)
        before[start > 0] = down[start[start > 0] - 1]
        return down - before
    out = out.copy()
    zero = np.zeros(width, np.uint8)
    for y in range(height):
        above = out[y - 1] if y else zero
        if kinds[y] == 2:
            out[y] += above
        elif kinds[y] in (3, 4):
            line, left, corner = rows[y], np.zeros(bpp, np.int16), np.zeros(bpp, np.int16)
            for x in range(0, width, bpp):
                over = above[x : x + bpp].astype(np.int16)
                guess = (left + over) // 2 if kinds[y] == 3 else _paeth(left, over, corner)
                left = (line[x : x + bpp] + guess) & 255
                out[y, x : x + bpp] = left
                corner = over
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit, non-interlaced PNG as (height, width, channels)."""
    stream, head, ended = [], None, False
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            stream.append(body)
        elif kind == b"IEND":
            ended = True
    if head is None or not ended:
        raise ValueError("PNG without header or end")
    width, height, depth, colour, _, _, interlace = head
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlace or channels is None:
        raise ValueError("only 8-bit gray or RGB images without interlace are read")
    raw = np.frombuffer(zlib.decompress(b"".join(stream)), np.uint8)
    raw = raw.reshape(height, width * channels + 1)
    if (raw[:, 0] > 4).any():
        raise ValueError("unknown row filter")
    return _unfilter(raw[:, 0], raw[:, 1:], channels).reshape(height, width, channels)


# ----------------------------------------------------------------- features


def _cosines(n: int, low: int) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


_BASIS = _cosines(_SIDE, _LOW)


def _shrunk(gray: np.ndarray, axis: int) -> np.ndarray:
    """Mean of each of _SIDE nearly equal parts along an axis; short axes repeat."""
    n = gray.shape[axis]
    if n < _SIDE:
        return np.take(gray, np.arange(_SIDE) * n // _SIDE, axis=axis)
    edges = np.arange(_SIDE + 1) * n // _SIDE
    shape = [1, 1]
    shape[axis] = _SIDE
    return np.add.reduceat(gray, edges[:-1], axis=axis) / np.diff(edges).reshape(shape)


def cosine_hash(pixels: np.ndarray) -> bytes:
    """64 bits: which low-frequency cosine coefficients exceed their median."""
    gray = pixels.mean(axis=2, dtype=np.float64)
    low = _BASIS @ _shrunk(_shrunk(gray, 0), 1) @ _BASIS.T
    flat = np.round(low.ravel(), 6)
    return np.packbits(flat > np.median(flat[1:])).tobytes()


# ---------------------------------------------------------------- operators


def store_media(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each text's UTF-8 bytes as a PNG in the binary column ``media``.

    Result: the key, ``n_bytes`` (before padding) and ``media``, one row for
    each input row.  A null or empty text is one row of spaces.  Equal texts
    give equal images; a text of any length is one image.  Columns other than
    key and text are not looked at.  An empty table gives an empty result.
    """

    @gives_back
    def encode(batches):
        for batch in batches:
            for part in steps(batch):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array([encode_png(pad(b)) for b in raw], pa.binary())],
                    names=[key, "n_bytes", "media"],
                )

    rows = pick(df, key, text)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(encode, f"`{key}` {kind}, n_bytes long, media binary")


def media_features(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read stored media back: payload digests and the cosine hash.

    A damaged image raises ValueError; a null image gives null results.  Equal
    images give equal results, and an empty table gives an empty one.
    """

    @gives_back
    def decode(batches):
        for batch in batches:
            for part in steps(batch):
                rows = []
                for data in part.column(2).to_pylist():
                    if data is None:
                        rows.append((None,) * 6)
                        continue
                    pixels = decode_png(data)
                    payload = pixels.tobytes()
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(pixels)))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]],
                    names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "visual_hash"],
                )

    rows = pick(df, key, "n_bytes", "media")
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(decode, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, visual_hash binary")


def op2_media(spark, sf_dir: str) -> DataFrame:
    """Every document stored as an image, read back and hashed."""
    from pyspark.sql import functions as F

    stored = store_media(table(spark, sf_dir, "documents"))
    return media_features(stored).withColumn("feature", F.lower(F.hex("visual_hash"))).drop("visual_hash")
