"""Digests of many short messages at once: every step of the hash is one numpy operation over all messages of a length."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa

# Messages hashed at once: their states stay in a core's cache.
LANES = 2048
# The primes of xxh64.
XXH_P1, XXH_P2, XXH_P3, XXH_P4, XXH_P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _left(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def by_length(messages: pd.Series, digest: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``digest`` of the messages' UTF-8 bytes, given as matrices of one length, in the order of the messages."""
    column = pa.array(messages, pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[: len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    size, out = np.diff(offsets), np.zeros(len(column), np.uint64)
    for n in np.unique(size).tolist():
        same = np.flatnonzero(size == n)
        for lo in range(0, len(same), LANES):
            rows = same[lo : lo + LANES]
            out[rows] = digest(data[offsets[rows][:, None] + np.arange(n)])
    return out


def xxh64(messages: np.ndarray) -> np.ndarray:
    """Unseeded xxh64 of equally long messages (n x length bytes)."""
    n, length = messages.shape
    stripes, at = length // 32, 0
    lane = lambda a, kind, size: np.ascontiguousarray(messages[:, a : a + size]).view(kind).reshape(-1).astype(np.uint64)
    turn = lambda acc, x: _left(acc + x * XXH_P2, 31) * XXH_P1
    if stripes:
        zero = np.zeros(n, np.uint64)
        acc = [zero + XXH_P1 + XXH_P2, zero + XXH_P2, zero, zero - XXH_P1]
        for _ in range(stripes):
            acc = [turn(acc[k], lane(at + 8 * k, "<u8", 8)) for k in range(4)]
            at += 32
        h = _left(acc[0], 1) + _left(acc[1], 7) + _left(acc[2], 12) + _left(acc[3], 18)
        for k in range(4):
            h = (h ^ turn(np.zeros(n, np.uint64), acc[k])) * XXH_P1 + XXH_P4
    else:
        h = np.full(n, XXH_P5, np.uint64)
    h = h + np.uint64(length)
    while at + 8 <= length:
        h = _left(h ^ turn(np.zeros(n, np.uint64), lane(at, "<u8", 8)), 27) * XXH_P1 + XXH_P4
        at += 8
    if at + 4 <= length:
        h = _left(h ^ lane(at, "<u4", 4) * XXH_P1, 23) * XXH_P2 + XXH_P3
        at += 4
    while at < length:
        h = _left(h ^ messages[:, at].astype(np.uint64) * XXH_P5, 11) * XXH_P1
        at += 1
    h = (h ^ h >> np.uint64(33)) * XXH_P2
    h = (h ^ h >> np.uint64(29)) * XXH_P3
    return h ^ h >> np.uint64(32)
