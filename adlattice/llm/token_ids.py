"""Token ids of a corpus in a compact, seekable file.

Ids are coded with one canonical, length-limited Huffman code made from the counts of the whole corpus. The file is a
Parquet folder with a ``code`` table (one row: symbols and code lengths) and a ``blocks`` table. A block holds whole
documents, some 2^18 ids, and decodes without any other block: it has its documents' ids and lengths, the bits, and
the bit offset of every ``CHECKPOINT``-th id, so that a reader can start there and many readers at once.

Blocks are numbered by (shard, block): shards are ranges of doc_id in ascending order. The start of a document in the
whole corpus is its place in the shard plus the totals of the shards before, which are as many numbers as shards.

Defined results: a null text is an empty one; a null doc_id comes first; rows with the same doc_id stand next to each
other, in an order that follows from their ids; strings of added tokens in a text get those tokens' ids, as the library gives them; a corpus without rows gives no blocks; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlattice.llm import pieces, pretoken, scan
from adlattice.session import fresh_path

MAX_BITS = 18
CHECKPOINT = 128
BLOCK_IDS = 1 << 18
SHARD_IDS = 1 << 22
END_ID = 0
#: Distinct pre-tokens that a worker keeps from task to task.
KEPT = 2_000_000
STAGED = "doc_id long, ids binary"
BLOCK = "shard int, block int, first long, n_ids long, doc_ids binary, null_ids binary, doc_lengths binary, checkpoints binary, bits binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


# ---- the code ----


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` (package-merge); 0 for symbols that don't occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols don't fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, row = [], weights
    for _ in range(max_bits):
        levels.append(row)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        row = np.sort(np.concatenate((weights, pairs)), kind="stable")
    # Which items of a level are symbols: a stable merge takes symbols first among equals.
    take, depth = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for below in [*reversed(levels[:-1]), None]:
        if below is None:
            symbols = min(take, len(order))
        else:
            pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(axis=1)
            rank = np.arange(len(weights)) + np.searchsorted(pairs, weights, "left")
            symbols = int(np.searchsorted(rank, take))
        depth[:symbols] += 1
        take = 2 * (take - symbols)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    code = at = 0
    for symbol in used[np.argsort(lengths[used], kind="stable")].tolist():
        code <<= int(lengths[symbol]) - at
        at = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for every possible next ``bits`` bits."""
    bits = int(lengths.max(initial=1))
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    span = 1 << (bits - lengths[used].astype(np.int64))
    symbols, sizes = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
    total = int(span.sum())
    symbols[:total] = np.repeat(used, span)
    sizes[:total] = np.repeat(lengths[used], span)
    return symbols, sizes, bits


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of the ids, most significant first, and the bit offset of every CHECKPOINT-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    if len(ids) == 0:
        return b"", np.zeros(0, np.uint32)
    starts = ends - size
    word, room = starts >> 5, 64 - (starts & 31) - size
    placed = codes[ids].astype(np.uint64) << room.astype(np.uint64)
    n_words = int(ends[-1] >> 5) + 2
    # Bits of different ids don't overlap, so sums are unions; below 2^32 they are exact in doubles.
    high = np.bincount(word, (placed >> np.uint64(32)).astype(np.float64), n_words)
    low = np.bincount(word + 1, (placed & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words)
    packed = (high + low).astype(np.uint64).astype(">u4").tobytes()
    return packed[: int(ends[-1] + 7) >> 3], starts[::CHECKPOINT].astype(np.uint32)


def decode(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The n ids of a block: one lane per checkpoint, all lanes a step at a time."""
    symbols, sizes, width = table
    raw = np.frombuffer(bits + bytes(CHECKPOINT * 4 + 8), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = checkpoints.astype(np.int64)
    out = np.empty((CHECKPOINT, len(at)), np.uint32)
    last = len(window) - 1
    for step in range(min(CHECKPOINT, n)):
        peek = (window[np.minimum(at >> 3, last)] >> (32 - width - (at & 7)).astype(np.uint32)) & np.uint32((1 << width) - 1)
        out[step] = symbols[peek]
        at += sizes[peek]
    return out.T.reshape(-1)[:n]


# ---- jobs ----


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): ids of each text as little-endian numbers, 2 bytes wide where the vocabulary allows, else 4.

    Each distinct pre-token is encoded by the library once per worker.
    """
    spark = docs.sparkSession
    wide = wide_ids(tokenizer_path)
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    kinds = spark.sparkContext.broadcast(pretoken.kinds("tokenizers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, specials = _worker_encoder(model, kinds)
        width = np.dtype("<u4" if wide else "<u2")
        for batch in batches:
            for lo, hi, data, off in scan.chunks(batch.column(1)):
                ids, first = specials.encode(encoder, data, off)
                ends = np.insert(ids.astype(width), first[1:], width.type(end_id))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pieces.binary(ends, first + np.arange(len(first)))], ["doc_id", "ids"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, STAGED)


def wide_ids(tokenizer_path: str) -> bool:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path).get_vocab_size() > 1 << 16


class Specials:
    """Added tokens that the library finds in a text before anything else, and their ids."""

    def __init__(self, model: str):
        added = [t for t in json.loads(model).get("added_tokens", []) if t["content"]]
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError("added tokens that take in what stands beside them aren't supported")
        self.ids = {t["content"].encode(): t["id"] for t in added}
        longest = sorted(self.ids, key=len, reverse=True)
        self.pattern = re.compile(b"|".join(map(re.escape, longest))) if longest else None

    def encode(self, encoder: pieces.PieceEncoder, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a chunk and the n + 1 first ids; texts are cut at added tokens, which have an id of their own."""
        found: list[tuple[int, int, int]] = []
        raw = data.tobytes()
        if self.pattern and self.pattern.search(raw):
            for a, b in zip(off.tolist(), off[1:].tolist()):
                found += [(m.start(), m.end(), self.ids[m.group()]) for m in self.pattern.finditer(raw, a, b)]
        if not found:
            return encoder.encode(data, off)
        starts, ends, own = (np.array(c, np.int64) for c in zip(*found))
        cuts = np.sort(np.concatenate((off, starts, ends)), kind="stable")
        ids, first = encoder.encode(data, cuts)
        # The piece that begins at a token and isn't empty is the token.
        at = np.searchsorted(cuts, starts, "right") - 1
        size = np.diff(first)
        keep = np.ones(len(ids), bool)
        keep[scan.ragged(first[at], size[at])] = False
        place = np.searchsorted(np.flatnonzero(keep), first[at])
        out = np.insert(ids[keep], place, own.astype(ids.dtype))
        size[at] = 1
        edges = np.concatenate(([0], np.cumsum(size)))
        return out, edges[np.searchsorted(cuts, off, "left")]


def library_ids(model: str):
    """Ids of pre-tokens by the library, many in one call: a line break stands between two of them."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(model)
    library.encode_special_tokens = True
    encode_all = getattr(library, "encode_batch_fast", library.encode_batch)
    (line_break,) = library.encode("\n", add_special_tokens=False).ids

    def resolve(new: list[bytes]) -> list[list[int]]:
        texts = [p.decode() for p in new]
        out: list[list[int]] = [[]] * len(texts)
        blank = [k for k, t in enumerate(texts) if t.isspace() or not t.strip()]
        for k, e in zip(blank, encode_all([texts[k] for k in blank], add_special_tokens=False)):
            out[k] = e.ids
        skip = set(blank)
        solid = [k for k in range(len(texts)) if k not in skip]
        for lo in range(0, len(solid), 8192):
            some = solid[lo : lo + 8192]
            ids = encode_all(["\n".join([texts[k] for k in some])], add_special_tokens=False)[0].ids
            cuts = np.flatnonzero(np.array(ids) == line_break).tolist()
            if len(cuts) != len(some) - 1:
                raise ValueError("the library splits pre-tokens otherwise than this module")
            for k, a, b in zip(some, [-1, *cuts], [*cuts, len(ids)]):
                out[k] = ids[a + 1 : b]
        return out

    return resolve


_WORKER: dict[int, tuple[pieces.PieceEncoder, Specials]] = {}


def _worker_encoder(model, kinds) -> tuple[pieces.PieceEncoder, Specials]:
    """One encoder per worker and vocabulary, so that later tasks find its pre-tokens."""
    key = zlib.crc32(model.value.encode())
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = pieces.PieceEncoder(library_ids(model.value), kinds.value, KEPT), Specials(model.value)
    return _WORKER[key]


def count_ids(staged: DataFrame, wide: bool) -> np.ndarray:
    """Occurrences of every id: as many rows as the vocabulary has reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            raw, _ = scan.utf8(batch.column(0))
            seen = np.bincount(raw.view("<u4" if wide else "<u2"))
            grown = np.zeros(max(len(total), len(seen)), np.int64)
            grown[: len(total)] = total
            grown[: len(seen)] += seen
            total = grown
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = staged.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def write_ids(staged: DataFrame, path: str, wide: bool = False, shard_ids: int = SHARD_IDS, block_ids: int = BLOCK_IDS) -> None:
    """Write (doc_id, ids) as one coded file set under ``path``, in ascending order of doc_id."""
    spark = staged.sparkSession
    counts = count_ids(staged, wide)
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(
        [(bytearray(used.astype("<u4").tobytes()), bytearray(lengths[used].tobytes()))], "symbols binary, lengths binary"
    ).coalesce(1).write.parquet(f"{path}/code")
    shared = spark.sparkContext.broadcast((canonical_codes(lengths), lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes = shared.value
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int, bool, np.ndarray]] = []
        n_held = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, held, n_held
            ids = np.concatenate([h[2] for h in held])
            bits, points = encode(ids, codes, sizes)
            numbers, nulls = np.array([h[0] for h in held], "<i8"), np.array([h[1] for h in held], np.uint8)
            each = np.array([len(h[2]) for h in held], "<u8")
            row = [shard, block, first, len(ids), numbers.tobytes(), nulls.tobytes(), each.tobytes(), points.astype("<u4").tobytes(), bits]
            block, first, held, n_held = block + 1, first + len(ids), [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], BLOCK.replace(",", "").split()[::2])

        for batch in batches:
            raw, off = scan.utf8(batch.column(1))
            flat, off = raw.view("<u4" if wide else "<u2"), off // (4 if wide else 2)
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                held.append((doc_id or 0, doc_id is None, flat[off[k] : off[k + 1]].copy()))
                n_held += int(off[k + 1] - off[k])
                if n_held >= block_ids:
                    yield flush()
        if held:
            yield flush()

    shards = max(spark.sparkContext.defaultParallelism, -(-int(counts.sum()) // shard_ids))
    # Rows that repeat a doc_id, or have none, may fill several shards.
    tie = F.xxhash64("ids")
    ordered = staged.repartitionByRange(shards, "doc_id", tie).sortWithinPartitions("doc_id", tie, "ids")
    ordered.mapInArrow(run, BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


def read_code(spark: SparkSession, path: str) -> np.ndarray:
    row = spark.read.parquet(f"{path}/code").first()
    symbols = np.frombuffer(row["symbols"], "<u4")
    lengths = np.zeros(int(symbols.max()) + 1 if len(symbols) else 0, np.uint8)
    lengths[symbols] = np.frombuffer(row["lengths"], np.uint8)
    return lengths


def shard_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard; a row per shard reaches the driver."""
    rows = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    starts, total = {}, 0
    for row in sorted(rows, key=lambda r: r["shard"]):
        starts[row["shard"]] = total
        total += row["n"]
    return starts


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): every document of a file set, its ids as little-endian 32-bit numbers."""
    return _read(spark, path, "doc_id long, start long, ids binary", lambda ids: ids.tobytes())


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded ids."""
    return _read(spark, path, RESULT, None)


def _read(spark: SparkSession, path: str, schema: str, value) -> DataFrame:
    shared = spark.sparkContext.broadcast((read_code(spark, path), shard_starts(spark, path)))
    names = schema.replace(",", "").split()[::2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, starts = shared.value
        table = decode_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode(row["bits"], np.frombuffer(row["checkpoints"], "<u4"), row["n_ids"], table).astype("<u4")
                each = np.frombuffer(row["doc_lengths"], "<u8").astype(np.int64)
                ends = np.cumsum(each)
                number = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["null_ids"], np.uint8) > 0)
                start = pa.array(starts[row["shard"]] + row["first"] + ends - each)
                parts = [ids[b - n : b] for b, n in zip(ends.tolist(), each.tolist())]
                if value:
                    columns = [number, start, pa.array([value(p) for p in parts], pa.binary())]
                else:
                    columns = [number, start, pa.array(each), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, schema)


def encoded_corpus(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Encode ``docs``, write the file set, and return what reading it back gives (``read_digests``)."""
    spark = docs.sparkSession
    folder = path or fresh_path(spark, "token-ids")
    tokenize(docs, tokenizer_path).write.option("compression", "zstd").parquet(f"{folder}/staged")
    write_ids(spark.read.parquet(f"{folder}/staged"), folder, wide_ids(tokenizer_path))
    return read_digests(spark, folder)
