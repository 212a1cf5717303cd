"""Simple-8b: word-aligned coding of ids, vectorised in both directions.

A 64-bit word holds a 4-bit selector and 60 bits of data.  A selector gives how
many ids of which width the word packs; ids of more than 60 bits follow an
escape word as they are.  Ids are coded in blocks of ``BLOCK`` ids that start
at a word boundary, so a block's offset is enough to decode it alone.

A unit (one file image) is, little-endian:

    magic 'S8B1', version u16, flags u16,
    u32 documents, u64 ids, u64 words, u32 block size, u32 blocks,
    i64 first position (ids before the unit in its shard),
    i64 document keys, u8 key-is-null flags, u32 ids of each document,
    u64 word offset of each block, u64 words, u32 crc32 of all before it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# Fixed values of the coding: selector -> (ids in a word, bits of each).
# Selectors 0 and 1 are runs of zero ids.  15 is the escape.
LAYOUT = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (1, 60))
ESCAPE = 15
BLOCK = 256
_HEAD = struct.Struct("<4sHHIQQIIq")


_COUNTS = np.array([c for c, _ in LAYOUT] + [1], np.int64)
#: Bits of each number below 65,536, which are the ids of all usual vocabularies.
_WIDTHS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)


def _width(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs; 0 for zero."""
    if len(ids) and int(ids.max()) < len(_WIDTHS):
        return _WIDTHS[ids.astype(np.intp)]
    if not len(ids) or int(ids.max()) < 1 << 52:
        return np.frexp(ids.astype(np.float64))[1].astype(np.int8)
    out = np.zeros(len(ids), np.int8)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step)
        out += np.where(high > 0, step, 0).astype(np.int8)
        rest = np.where(high > 0, high, rest)
    return out + (rest > 0)


def _selectors(ids: np.ndarray, block: int) -> np.ndarray:
    """For each position the selector that packs most ids from there on, within its block."""
    n = len(ids)
    width = _width(ids)
    # Ids left in a position's block.
    room = np.resize(np.arange(block, 0, -1, dtype=np.int16), n)
    room[n - n % block :] = np.arange(n % block, 0, -1)
    best = np.full(n, ESCAPE, np.int8)
    widest, reach = width.copy(), 1
    # From few ids to many, so that each window's maximum grows from a shorter one.
    for selector in range(len(LAYOUT) - 1, -1, -1):
        count, bits = LAYOUT[selector]
        if np.count_nonzero(width <= bits) < count:
            break  # wider words need even smaller ids
        while reach < count:
            step = min(reach, count - reach)
            widest[: n - step] = np.maximum(widest[: n - step], widest[step:])
            reach += step
        fits = widest <= bits
        if count > 1:
            fits &= room >= count
        best -= fits  # what fits a selector fits all those after it, so this counts down to the first
    return best


def encode_words(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ids, and each block's first word.

    The chains of words of all blocks are followed side by side; the words are
    then packed selector by selector.
    """
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    best = _selectors(ids, block)
    at = np.arange(0, n, block)
    end = np.minimum(at + block, n)
    begins = np.zeros(n, bool)
    while len(at):
        begins[at] = True
        at = at + _COUNTS[best[at]]
        live = at < end
        at, end = at[live], end[live]
    starts = np.flatnonzero(begins)
    chosen = best[starts].astype(np.int64)
    escaped = chosen == ESCAPE
    place = np.arange(len(starts)) + np.cumsum(escaped) - escaped
    words = np.zeros(len(starts) + int(escaped.sum()), np.uint64)
    for selector in np.unique(chosen):
        mine = np.flatnonzero(chosen == selector)
        word = np.full(len(mine), selector, np.uint64)
        if selector == ESCAPE:
            words[place[mine] + 1] = ids[starts[mine]]
        else:
            count, bits = LAYOUT[selector]
            begin = starts[mine]
            for k in range(count if bits else 0):
                word |= ids[begin + k] << np.uint64(4 + k * bits)
        words[place[mine]] = word
    return words, place[np.searchsorted(starts, np.arange(0, n, block))].astype(np.uint64)


def decode_words(words: np.ndarray, total: int | None = None) -> np.ndarray:
    """All ids of the words, in order, without a loop over words."""
    words = np.ascontiguousarray(words, np.uint64)
    selectors = (words & np.uint64(15)).astype(np.int64)
    data = np.ones(len(words), bool)
    if (selectors == ESCAPE).any():
        # A word behind an escape is data; only then is there anything to walk.
        for at in np.flatnonzero(selectors == ESCAPE).tolist():
            if data[at]:
                data[at + 1] = False
    counts = np.where(data, _COUNTS[selectors], 0)
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for selector in np.unique(selectors[data]):
        mine = np.flatnonzero(data & (selectors == selector))
        if selector == ESCAPE:
            out[starts[mine]] = words[mine + 1]
            continue
        count, bits = LAYOUT[selector]
        if bits:
            mask = np.uint64((1 << bits) - 1)
            body, first = words[mine], starts[mine]
            for k in range(count):
                out[first + k] = (body >> np.uint64(4 + k * bits)) & mask
    if total is not None and len(out) != total:
        raise ValueError(f"{len(out)} ids decoded, {total} expected")
    return out


def pack_unit(keys: list, lengths: list[int], ids: np.ndarray, before: int) -> bytes:
    """One unit: whole documents, their ids one after another."""
    words, offsets = encode_words(ids)
    null = np.array([k is None for k in keys], np.uint8)
    head = _HEAD.pack(b"S8B1", 1, 0, len(keys), len(ids), len(words), BLOCK, len(offsets), before)
    body = b"".join([head, np.array([k or 0 for k in keys], "<i8").tobytes(), null.tobytes(), np.array(lengths, "<u4").tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()])
    return body + struct.pack("<I", zlib.crc32(body))


class Unit:
    """A unit read back; raises ValueError where it is damaged."""

    def __init__(self, data: bytes):
        if len(data) < _HEAD.size + 4 or data[:4] != b"S8B1":
            raise ValueError("not a Simple-8b unit")
        if struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("checksum of a Simple-8b unit does not match")
        _, _, _, documents, self.total, n_words, self.block, blocks, self.before = _HEAD.unpack_from(data)
        at = _HEAD.size
        self.keys = [None if z else k for k, z in zip(np.frombuffer(data, "<i8", documents, at).tolist(), data[at + 8 * documents : at + 9 * documents], strict=True)]
        at += 9 * documents
        self.lengths = np.frombuffer(data, "<u4", documents, at).astype(np.int64)
        at += 4 * documents
        self.offsets = np.frombuffer(data, "<u8", blocks, at).astype(np.int64)
        at += 8 * blocks
        self.words = np.frombuffer(data, "<u8", n_words, at)

    def ids(self) -> np.ndarray:
        return decode_words(self.words, self.total)

    def block_ids(self, k: int) -> np.ndarray:
        """Ids of one block alone, found through its offset."""
        end = self.offsets[k + 1] if k + 1 < len(self.offsets) else len(self.words)
        return decode_words(self.words[self.offsets[k] : end])
