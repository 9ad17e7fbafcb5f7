"""Vectorised scans over UTF-8 text inside Arrow tasks.

Texts are read from the Arrow buffers without making Python strings. A chunk holds whole texts up to about
half a megabyte, or one longer text, so the memory of a task doesn't depend on the number of rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _byte_set(keep: Callable[[int], bool]) -> np.ndarray:
    return np.fromiter((keep(b) for b in range(256)), dtype=bool, count=256)


#: Bytes of words ``[^\x20\x09-\x0D]+``.
SOLID = _byte_set(lambda b: b != 32 and not 9 <= b <= 13)
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: digits, letters and all beyond ASCII.
ALNUM = _byte_set(lambda b: 48 <= b <= 57 or 97 <= (b + 32 if 65 <= b <= 90 else b) <= 122 or b >= 128)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    off = off.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces with whole texts."""
    raw, off = utf8(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least n of each."""
    return _powers(max(CHUNK + 1, 1 << int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Prefix:
    """Hashes of any substrings of a chunk: differences of one running sum."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data) + 1)
        values = data.astype(np.uint64)
        values += np.uint64(1)
        values *= self.up[: len(data)]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[start:end]; equal substrings have equal hashes wherever they stand."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk and the n + 1 numbers of each text's first one."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    points = data[at].astype(np.uint32)
    long = np.flatnonzero(points >= 0xC0)
    if len(long):
        first, place = points[long], at[long]
        size = np.where(first >= 0xF0, 4, np.where(first >= 0xE0, 3, 2))
        value = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
        for k in (1, 2, 3):
            more = size > k
            value[more] = value[more] << 6 | (data[place[more] + k] & 0x3F)
        points[long] = value
    return points, np.searchsorted(at, off)


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that don't cross a text's border."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    cuts = off[1:-1]
    before[cuts[cuts < n]] = False
    after[cuts[cuts > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def words(data: np.ndarray, off: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of a chunk: hashes, starts, ends, and each text's first word (n + 1 numbers)."""
    starts, ends = runs(kept[data], off)
    return Prefix(LOWER[data]).hashes(starts, ends), starts, ends, np.searchsorted(starts, off)


def owners(first: np.ndarray) -> np.ndarray:
    """The text of each item, from the n + 1 first-item numbers."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Totals of the items of each text; empty texts have 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every (start, length), one after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    step[0] = starts[0]
    step[heads[1:]] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


#: Keys that are placed at once, so that large tables need little more than themselves.
_PLACED = 1 << 18


class HashTable:
    """64-bit keys to their positions, probed for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, np.uint64)
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32 if len(keys) < 1 << 31 else np.int64)
        for lo in range(0, len(keys), _PLACED):
            left = np.arange(lo, min(lo + _PLACED, len(keys)))
            at = (mix(self.keys[lo : lo + _PLACED]) >> self.shift).astype(np.int64)
            while len(left):
                free = self.slots[at] < 0
                self.slots[at[free]] = left[free]
                lost = self.slots[at] != left
                left, at = left[lost], (at[lost] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is not held."""
        at = (mix(keys) >> self.shift).astype(np.int64)
        got = self.slots[at].astype(np.int64)
        if not len(self.keys):
            return got
        odd = np.flatnonzero((got >= 0) & (self.keys[got] != keys))
        while len(odd):
            at[odd] = (at[odd] + 1) & self.mask
            now = self.slots[at[odd]].astype(np.int64)
            got[odd] = now
            odd = odd[(now >= 0) & (self.keys[now] != keys[odd])]
        return got


class SortedTable:
    """Different 64-bit keys, ascending as signed numbers and spread evenly, to their positions; probed as ``HashTable`` is.

    Besides the keys it holds 2 to 4 bytes for each: the first position for every value of their upper bits.
    """

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys).view(np.int64)
        bits = max(4, len(keys).bit_length() - 1)
        self.shift, self.half = 64 - bits, 1 << (bits - 1)
        self.first = np.empty((1 << bits) + 1, np.int32 if len(keys) < 1 << 31 else np.int64)
        self.first[-1] = len(keys)
        for lo in range(0, 1 << bits, _PLACED):
            upper = np.arange(lo, min(lo + _PLACED, 1 << bits)) - self.half
            self.first[lo : lo + len(upper)] = np.searchsorted(self.keys, upper << self.shift)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is not held."""
        keys = keys.view(np.int64)
        upper = (keys >> self.shift) + self.half
        got, end = self.first[upper].astype(np.int64), self.first[upper + 1]
        odd = np.flatnonzero(got < end)
        got[got >= end] = -1
        while len(odd):
            odd = odd[self.keys[got[odd]] != keys[odd]]
            got[odd] += 1
            over = got[odd] >= end[odd]
            got[odd[over]] = -1
            odd = odd[~over]
        return got


def crc_of_id(ids: pa.Array) -> np.ndarray:
    """crc32 of each id written as text; -1 for a null id."""
    import zlib

    return np.fromiter((-1 if x is None else zlib.crc32(str(x).encode()) for x in ids.to_pylist()), np.int64, len(ids))
