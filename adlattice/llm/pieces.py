"""Ids of whole chunks of text from the ids of their distinct pre-tokens."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from adlattice.llm import pretoken, scan

#: Distinct pre-tokens that a worker keeps at once (some 80 bytes each); beyond it starts anew.
KEPT = 600_000


class PieceEncoder:
    """Encodes texts of a worker; ``resolve`` gives the ids of pre-tokens not met before."""

    def __init__(self, resolve: Callable[[list[bytes]], list[list[int]]], kinds: np.ndarray, kept: int = KEPT):
        self.resolve, self.kinds, self.kept = resolve, kinds, kept
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.table = scan.HashTable(self.keys)
        self.fresh: dict[int, int] = {}
        self.from_, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        got = self.resolve(pieces)
        count = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for ids in got for i in ids), np.uint32, int(count.sum()))
        self.from_ = np.concatenate((self.from_, len(self.ids) + np.cumsum(count) - count))
        self.count = np.concatenate((self.count, count))
        self.ids = np.concatenate((self.ids, flat))
        self.keys = np.concatenate((self.keys, hashes))

    def _positions(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        at = self.table.find(hashes)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, first, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            held = np.fromiter((self.fresh.get(h, -1) for h in new.tolist()), np.int64, len(new))
            unknown = np.flatnonzero(held < 0)
            if len(unknown):
                rows = missing[first[unknown]]
                base = len(self.keys)
                self._learn(new[unknown], [data[a:b].tobytes() for a, b in zip(starts[rows], ends[rows])])
                held[unknown] = base + np.arange(len(unknown))
                self.fresh.update(zip(new[unknown].tolist(), held[unknown].tolist()))
            at[missing] = held[back]
            if len(self.fresh) > max(4096, len(self.table.keys) // 4):
                self.table, self.fresh = scan.HashTable(self.keys), {}
        return at

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk, and the n + 1 numbers of each text's first id."""
        if len(self.keys) > self.kept:
            self._clear()
        starts = pretoken.split(data, off, self.kinds)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        at = self._positions(scan.Prefix(data).hashes(starts, ends), starts, ends, data)
        count = self.count[at]
        heads = np.concatenate(([0], np.cumsum(count)))
        return self.ids[scan.ragged(self.from_[at], count)], heads[np.searchsorted(starts, off)]


def binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """One binary value per text from the flat values and the n + 1 first positions."""
    raw = np.ascontiguousarray(values)
    width = raw.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(first) - 1, [None, pa.py_buffer((first * width).astype(np.int64)), pa.py_buffer(raw.view(np.uint8))]
    ).cast(pa.binary())
