"""Byte-level BPE by the ranks of a public vocabulary.

Encoding looks up a pre-token in two tiers. A minimal perfect hash over the vocabulary's byte strings resolves pre-tokens
that are tokens themselves; what it returns is compared byte by byte. All others are merged from single bytes: a heap
holds the neighbouring pairs by (rank, place), the bytes are linked in both directions.

Defined results: a null text is an empty one and gives no ids; equal texts give equal rows; other columns are ignored;
a table without rows gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.llm import pieces, pretoken, scan

ENCODED = "doc_id long, ids binary"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> list[bytes]:
    """The byte string of every id of a rank file."""
    with open(path, "rb") as f:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f)]
    tokens = [b""] * (max(pairs)[0] + 1)
    for rank, token in pairs:
        tokens[rank] = token
    return tokens


class PerfectHash:
    """Hash and displace: every key has a slot of its own among as many slots as keys."""

    def __init__(self, hashes: np.ndarray, load: int = 2):
        n = len(hashes)
        self.n, self.buckets = n, max(1, -(-n // load))
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot_of = np.full(n, -1, np.int64)
        group = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        size = np.bincount(group, minlength=self.buckets)
        first = np.cumsum(size) - size
        for b in np.flatnonzero(size > 1)[np.argsort(-size[size > 1], kind="stable")].tolist():
            members = order[first[b] : first[b] + size[b]]
            self._place(b, members, hashes[members])
        # A bucket of one key names its slot outright.
        alone, free = np.flatnonzero(size == 1), np.flatnonzero(self.slot_of < 0)
        self.shift[alone] = -1 - free
        self.slot_of[free] = order[first[alone]]

    def _place(self, bucket: int, members: np.ndarray, hashes: np.ndarray) -> None:
        d = 0
        while True:
            tries = np.arange(d, d + 64, dtype=np.uint64)
            slots = self._slots(hashes, tries[:, None])
            ordered = np.sort(slots, axis=1)
            fits = (self.slot_of[slots] < 0).all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if fits.any():
                k = int(fits.argmax())
                self.shift[bucket] = d + k
                self.slot_of[slots[k]] = members
                return
            d += 64

    def _slots(self, hashes: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (scan.mix(hashes + d * np.uint64(0xD1342543DE82EF95)) % np.uint64(self.n)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of the only key that may have each hash."""
        d = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return self.slot_of[np.where(d < 0, -1 - d, self._slots(hashes, d.astype(np.uint64)))]


def byte_hashes(values: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(values), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, values), np.int64, len(values)))
    starts = np.concatenate(([0], ends[:-1])) if len(values) else ends
    return scan.Prefix(data).hashes(starts, ends)


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token by merging the pair of least rank, the leftmost first."""
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at each place; 0 once merged away
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or ranks.get(piece[i : end[mid]]) != rank:
            continue  # one of the two has changed since
        end[i], end[mid] = end[mid], 0
        after = end[i]
        if after < n:
            before[after] = i
            if (r := ranks.get(piece[i : end[after]])) is not None:
                heapq.heappush(heap, (r, i))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : after])) is not None:
            heapq.heappush(heap, (r, before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Vocabulary:
    """Byte strings of all ids with both tiers of the lookup."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = np.array([i for i, t in enumerate(tokens) if t], np.int64)
        self.index = PerfectHash(byte_hashes([tokens[i] for i in self.ids]))
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)
        self._ranks: dict[bytes, int] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_ranks": None}

    def resolve(self, new: list[bytes]) -> list[list[int]]:
        if self._ranks is None:
            self._ranks = {t: i for i, t in enumerate(self.tokens) if t}
        found = self.ids[self.index.find(byte_hashes(new))].tolist()
        return [[i] if self.tokens[i] == piece else merge_bytes(piece, self._ranks) for i, piece in zip(found, new)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the ids, and the place of each id's first byte (one more at the end)."""
        size = self.size[ids]
        return self.blob[scan.ragged(self.start[ids], size)], np.concatenate(([0], np.cumsum(size)))


def _task_encoder(shared) -> pieces.PieceEncoder:
    """An encoder that lives as long as its task."""
    return pieces.PieceEncoder(shared.value[0].resolve, shared.value[1])


def _shared(docs: DataFrame, ranks_path: str):
    return docs.sparkSession.sparkContext.broadcast((Vocabulary(read_ranks(ranks_path)), pretoken.kinds("tiktoken")))


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids): ids of every text as little-endian unsigned 32-bit numbers."""
    shared = _shared(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _task_encoder(shared)
        for batch in batches:
            for lo, hi, data, off in scan.chunks(batch.column(1)):
                ids, first = encoder.encode(data, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pieces.binary(ids.astype("<u4"), first)], ["doc_id", "ids"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, bytes): the byte strings of (doc_id, ids). An id outside the vocabulary is an error."""
    shared = _shared(encoded, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value[0]
        for batch in batches:
            for lo, hi, raw, off in scan.chunks(batch.column(1)):
                data, places = vocabulary.decode(raw.view("<u4").astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pieces.binary(data, places[off // 4])], ["doc_id", "bytes"]
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """Digests of the ids of every text and of the bytes that the ids decode to."""
    shared = _shared(docs, ranks_path)

    def digests(values: np.ndarray, first: np.ndarray) -> pa.Array:
        cuts = first.tolist()
        return pa.array([hashlib.sha256(values[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocabulary = _task_encoder(shared), shared.value[0]
        for batch in batches:
            for lo, hi, data, off in scan.chunks(batch.column(1)):
                ids, first = encoder.encode(data, off)
                back, places = vocabulary.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(first)),
                        digests(ids.astype("<u4"), first),
                        digests(back, places[first]),
                    ],
                    RESULT.replace(",", "").split()[::2],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)
