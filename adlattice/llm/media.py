"""ISO media files in a binary column: tracks, duration and the byte ranges of key frames.

``index_media`` walks the nested boxes of each file and decodes the sample tables; payloads are never decoded.
``store_samples`` writes bytes losslessly as the raw 8-bit samples of one sound track, ``read_samples`` gets them back
through the sample tables.

Defined results: a null file gives null columns; bytes that aren't a whole ISO media file give ``error`` and no tracks;
a null text is an empty one; equal texts give equal rows; other columns are ignored; a table without rows gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.llm import scan

#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
#: Boxes are read down to this depth; the format needs six.
DEEPEST = 32
FRAME = 576
PAD = 255
RATE = 8000
KEY_EVERY = 8

TRACK = (
    "track_id long, handler string, codec string, timescale long, duration long, n_samples long, sample_bytes long, "
    "n_keyframes long, keyframes array<struct<offset:long,size:long>>"
)
INDEX = f"duration_s double, tracks array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in TRACK.split(', '))}>>, error string"
RESULT = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


class MediaError(ValueError):
    """The bytes break the format."""


@dataclass
class Track:
    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    chunk_offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    chunk_runs: list[tuple[int, int]] = field(default_factory=list)
    times: list[tuple[int, int]] = field(default_factory=list)
    sync: np.ndarray | None = None

    def offsets(self) -> np.ndarray:
        """File offset of every sample: its chunk's offset plus the samples before it in the chunk."""
        n, chunks = len(self.sizes), len(self.chunk_offsets)
        if n == 0:
            return np.zeros(0, np.int64)
        first = np.array([f for f, _ in self.chunk_runs], np.int64)
        if len(first) == 0 or first[0] != 1 or (np.diff(first) <= 0).any() or first[-1] > chunks:
            raise MediaError("chunk runs don't fit the chunks")
        per_chunk = np.repeat([k for _, k in self.chunk_runs], np.diff(np.append(first, chunks + 1)))
        if int(per_chunk.sum()) != n:
            raise MediaError("chunks and samples differ in number")
        before = np.cumsum(self.sizes) - self.sizes
        head = np.cumsum(per_chunk) - per_chunk
        # Chunks without samples point past the end; they are not repeated below.
        base = self.chunk_offsets - before[np.minimum(head, n - 1)]
        return np.repeat(base, per_chunk) + before

    def keyframes(self) -> np.ndarray:
        """0-based numbers of the key frames; every sample is one where the file names none."""
        return np.arange(len(self.sizes)) if self.sync is None else self.sync - 1


# ---- reading ----


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of the body, end) of the boxes between two places."""
    while start < end:
        if end - start < 8:
            raise MediaError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise MediaError("a box header is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop < body or stop > end:
            raise MediaError(f"box {kind!r} doesn't fit what holds it")
        yield kind, body, stop
        start = stop


def _numbers(data: memoryview, at: int, end: int, kind: str, columns: int = 1) -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at)
    width = np.dtype(kind).itemsize * columns
    if at + 4 + n * width > end:
        raise MediaError("a table is cut off")
    return np.frombuffer(data, kind, n * columns, at + 4).astype(np.int64).reshape(n, columns)


def _read_box(data: memoryview, kind: bytes, at: int, end: int, track: Track) -> None:
    if kind == b"tkhd":
        track.track_id = struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0]
    elif kind == b"mdhd":
        track.timescale, track.duration = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
        if track.duration >= 1 << 63:
            raise MediaError("a duration is too long")
    elif kind == b"hdlr":
        track.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
    elif kind == b"stsd":
        for codec, _, _ in boxes(data, at + 8, end):
            track.codec = codec.decode("latin-1")
            break
    elif kind == b"stts":
        track.times = [tuple(r) for r in _numbers(data, at + 4, end, ">u4", 2).tolist()]
    elif kind == b"stsc":
        track.chunk_runs = [(a, b) for a, b, _ in _numbers(data, at + 4, end, ">u4", 3).tolist()]
    elif kind in (b"stco", b"co64"):
        track.chunk_offsets = _numbers(data, at + 4, end, ">u4" if kind == b"stco" else ">u8")[:, 0]
    elif kind == b"stss":
        track.sync = _numbers(data, at + 4, end, ">u4")[:, 0]
    elif kind == b"stsz":
        size, n = struct.unpack_from(">II", data, at + 4)
        if size and n * size > len(data):
            raise MediaError("samples are longer than the file")
        track.sizes = np.full(n, size, np.int64) if size else _numbers(data, at + 8, end, ">u4")[:, 0]
    elif kind == b"stz2":
        bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if bits == 4:
            raw = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12)
            track.sizes = np.stack((raw >> 4, raw & 15), axis=1).reshape(-1)[:n].astype(np.int64)
        elif bits in (8, 16):
            track.sizes = _numbers(data, at + 8, end, ">u1" if bits == 8 else ">u2")[:, 0]
        else:
            raise MediaError(f"sample sizes of {bits} bits")


def read_tracks(raw: bytes) -> list[Track]:
    """All tracks of a file; the sample tables are checked against each other and the file's end."""
    data, tracks = memoryview(raw), []

    def walk(start: int, end: int, track: Track | None, depth: int = 0) -> None:
        if depth > DEEPEST:
            raise MediaError("boxes are nested too deep")
        for kind, body, stop in boxes(data, start, end):
            if kind == b"trak":
                tracks.append(Track())
                walk(body, stop, tracks[-1], depth + 1)
            elif kind in NESTED:
                walk(body, stop, track, depth + 1)
            elif track is not None:
                _read_box(data, kind, body, stop, track)

    try:
        kinds = [kind for kind, _, _ in boxes(data, 0, len(data))]
        if b"moov" not in kinds:
            raise MediaError("no movie box")
        walk(0, len(data), None)
    except (struct.error, ValueError, IndexError) as e:
        raise e if isinstance(e, MediaError) else MediaError(str(e)) from e
    for track in tracks:
        at = track.offsets()
        if len(at) and (at.min() < 0 or (at + track.sizes).max() > len(raw)):
            raise MediaError("a sample lies outside the file")
        keys = track.keyframes()
        if len(keys) and (keys.min() < 0 or keys.max() >= len(track.sizes)):
            raise MediaError("a key frame is no sample")
    return tracks


def seconds(tracks: list[Track]) -> float:
    return max((t.duration / t.timescale for t in tracks if t.timescale), default=0.0)


def read_samples(raw: bytes, track: int = 0) -> bytes:
    """All samples of one track, one after another."""
    t = read_tracks(raw)[track]
    data = np.frombuffer(raw, np.uint8)
    return data[scan.ragged(t.offsets(), t.sizes)].tobytes() if len(t.sizes) else b""


# ---- writing ----


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def store_samples(payload: bytes, frame: int = FRAME, rate: int = RATE, key_every: int = KEY_EVERY) -> bytes:
    """A file with one track of raw unsigned 8-bit mono sound; a sample of the tables is ``frame`` bytes.

    Every ``key_every``-th sample is named a key frame, and chunks hold as many samples.
    """
    n = len(payload) // frame
    if n * frame != len(payload) or n == 0:
        raise ValueError(f"the payload must be a positive multiple of {frame} bytes")
    chunks = -(-n // key_every)
    long = 0 if len(payload) < 1 << 31 else 1
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")
    entry = _box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, rate << 16))
    times = _full(b"stts", struct.pack(">III", 1, n, frame))
    runs = [(1, min(key_every, n))]
    if n > key_every and n % key_every:
        runs.append((chunks, n % key_every))
    to_chunks = _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", a, b, 1) for a, b in runs])
    sizes = _full(b"stsz", struct.pack(">II", frame, n))
    sync = _full(b"stss", struct.pack(">I", chunks), (np.arange(chunks) * key_every + 1).astype(">u4").tobytes())

    def movie(at: int) -> bytes:
        places = at + np.arange(chunks, dtype=np.int64) * (frame * key_every)
        offsets = _full(b"co64" if long else b"stco", struct.pack(">I", chunks), places.astype(">u8" if long else ">u4").tobytes())
        table = _box(b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), times, sync, to_chunks, sizes, offsets)
        data_ref = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, rate, n * frame, 0x55C4, 0), version=1),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            _box(b"minf", _full(b"smhd", bytes(4)), data_ref, table),
        )
        track_head = struct.pack(">QQIIQ", 0, 0, 1, 0, n * frame) + struct.pack(">8xhhhH", 0, 0, 0x100, 0) + _MATRIX + bytes(8)
        movie_head = struct.pack(">QQIQ", 0, 0, rate, n * frame) + struct.pack(">IH10x", 0x10000, 0x100) + _MATRIX + bytes(24)
        return _box(
            b"moov",
            _full(b"mvhd", movie_head, struct.pack(">I", 2), version=1),
            _box(b"trak", _full(b"tkhd", track_head, version=1, flags=7), media),
        )

    size = len(movie(0))
    start = len(head) + size + (16 if long else 8)
    data = struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if long else struct.pack(">I4s", len(payload) + 8, b"mdat")
    return b"".join((head, movie(start), data, payload))


# ---- jobs ----


def index_media(files: DataFrame, column: str = "content") -> DataFrame:
    """The other columns of ``files`` and, for each file, its duration, tracks and key-frame byte ranges.

    Columns of ``files`` with the names duration_s, tracks or error are replaced.
    """
    kept = [c for c in files.columns if c not in (column, "duration_s", "tracks", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                out = _described(row.column(0)[0].as_py())
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[1:], pa.array([out[0]], pa.float64()), pa.array([out[1]], _TRACKS), pa.array([out[2]], pa.string())],
                    [*kept, "duration_s", "tracks", "error"],
                )

    typed = files.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in typed.schema], INDEX])
    return files.select(F.col(f"`{column}`").cast("binary"), *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


_TRACKS = pa.list_(
    pa.struct(
        [
            ("track_id", pa.int64()),
            ("handler", pa.string()),
            ("codec", pa.string()),
            *[(n, pa.int64()) for n in ("timescale", "duration", "n_samples", "sample_bytes", "n_keyframes")],
            ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))),
        ]
    )
)


def _described(raw: bytes | None) -> tuple[float | None, list[dict] | None, str | None]:
    if raw is None:
        return None, None, None
    try:
        tracks = read_tracks(raw)
    except MediaError as e:
        return None, [], str(e)
    out = []
    for t in tracks:
        at, keys = t.offsets(), t.keyframes()
        out.append(
            {
                "track_id": t.track_id,
                "handler": t.handler,
                "codec": t.codec,
                "timescale": t.timescale,
                "duration": t.duration,
                "n_samples": len(t.sizes),
                "sample_bytes": int(t.sizes.sum()),
                "n_keyframes": len(keys),
                "keyframes": [{"offset": a, "size": b} for a, b in zip(at[keys].tolist(), t.sizes[keys].tolist())],
            }
        )
    return seconds(tracks), out, None


def feature_text(raw: bytes) -> str:
    """Codec, seconds and key frames of a file, the byte ranges as a digest."""
    parts = []
    tracks = read_tracks(raw)
    for t in tracks:
        at, keys = t.offsets(), t.keyframes()
        ranges = np.stack((at[keys], t.sizes[keys])).astype("<i8").tobytes()
        parts.append(f"{t.handler}/{t.codec.strip()} samples={len(t.sizes)} keyframes={len(keys)} ranges={hashlib.sha256(ranges).hexdigest()[:16]}")
    return f"seconds={seconds(tracks):.3f} " + "; ".join(parts)


def stored_texts(docs: DataFrame) -> DataFrame:
    """Stores every text as a media file, reads it back, and describes what was stored and read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in scan.chunks(batch.column(1)):
                rows: list[list] = [[] for _ in range(7)]
                cuts = off.tolist()
                for a, b in zip(cuts, cuts[1:]):
                    n = b - a
                    size = max(1, -(-n // FRAME)) * FRAME
                    media = store_samples(data[a:b].tobytes() + bytes([PAD]) * (size - n))
                    back = read_samples(media)
                    values = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media))
                    for column, value in zip(rows, (*values, hashlib.sha256(media).hexdigest(), feature_text(media))):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *[pa.array(v, k) for v, k in zip(rows, kinds)]],
                    RESULT.replace(",", "").split()[::2],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, RESULT)
