"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids end together.

A text is coded by A (byte-level BPE, of a space and the text) and by B (pieces, which puts the space itself). Ends of tokens
are byte offsets. Offsets at which a token of each ends cut the text into groups.

Divide and conquer at shared cuts: an interval of A's tokens looks for a common end near its middle, asking by
bisect whether B has that end too, first for the middle and then for twice as many neighbours each time. The end found
cuts the interval, and both halves are treated the same way; an interval without one inside is a leaf and becomes a group.
All intervals of a chunk of texts go down one level at a time, as arrays.

Corpus counts. A link is a pair of tokens that end together; the links of every text are written as numbers of id pairs, and counted for
all texts by Spark. The most frequent pairs (``HEAD`` at most, bounded by that parameter) are sent to the tasks, which look
the links of their texts up; links of rarer pairs are joined with the table of counts. Neither drops a pair.

Ids are asked from the libraries once for every distinct piece a worker meets: A's pre-tokens by their pattern; for B a run
of spaces with what follows up to the next space, which no piece crosses. The libraries see whole pieces, so the ids are those
of the whole text.

Defined results: null and empty texts, and texts whose tokens don't give the bytes of space and text back (such as those with
U+2581, which B reads as a space), have no tokens, zeros, and an empty ``groups_sha256``. Rows are kept as they are, repeated or
without doc_id; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.llm import pieces, pretoken, scan, token_ids
from adlattice.session import durable, fresh_path

#: Pairs that are sent to every task (some 20 bytes each).
HEAD = 1 << 20
#: Ids of pieces that a worker keeps at once.
KEPT_IDS = 4_000_000
#: Different pairs that a task counts before it hands them on.
COUNTED = 1 << 20

STAGED = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# ---- ids ----


def byte_level_lengths(model: str) -> np.ndarray:
    """Bytes of every token of a byte-level vocabulary: it writes one character for each."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_str(model).get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    return out


class Pieces:
    """B's vocabulary: bytes of every piece, and the ids of stretches of text that open with a space."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        byte = [self.library.is_byte(i) for i in range(n)]
        plain = [not (self.library.is_control(i) or self.library.is_unknown(i)) for i in range(n)]
        if any("▁" in p.lstrip("▁") for p in names):
            raise ValueError("a piece goes on after a space: texts can't be cut before spaces")
        self.bytes = [
            bytes([int(p[3:-1], 16)]) if b else p.replace("▁", " ").encode() if real else b""
            for p, b, real in zip(names, byte, plain)
        ]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.space = [self.library.piece_to_id("▁")]
        self.unknown = [self.library.unk_id()]

    def resolve(self, new: list[bytes]) -> list[list[int]]:
        """Ids of each stretch; the unknown id where they don't give its bytes back."""
        rest = [p[1:].decode() for p in new]
        got = self.library.encode(rest, num_threads=1) if rest else []
        out = []
        for piece, left, ids in zip(new, rest, got):
            ids = ids if left else self.space
            out.append(ids if b"".join([self.bytes[i] for i in ids]) == piece else self.unknown)
        return out


def before_spaces(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of stretches: the first space of every run of spaces, and every text's first byte."""
    space = data == 32
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[off[:-1][off[:-1] < len(data)]] = True
    return np.flatnonzero(start)


class Encoder(pieces.PieceEncoder):
    """A worker's ids for texts that are cut by ``cut``."""

    def __init__(self, resolve: Callable[[list[bytes]], list[list[int]]], cut: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        super().__init__(resolve, np.zeros(0, np.uint8))
        self.cut = cut

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > self.kept or len(self.ids) > KEPT_IDS:
            self._clear()
        starts = self.cut(data, off)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        at = self._positions(scan.Prefix(data).hashes(starts, ends), starts, ends, data)
        count = self.count[at]
        heads = np.concatenate(([0], np.cumsum(count)))
        return self.ids[scan.ragged(self.from_[at], count)], heads[np.searchsorted(starts, off)]


# ---- alignment ----


def common_ends(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places in ``a`` of the ends that ``b`` has too, in order.

    ``a`` and ``b`` are increasing; ``first`` are the n + 1 first tokens of each text in ``a``. Every text ends in both.
    """
    lo, hi = first[:-1].astype(np.int64), first[1:].astype(np.int64) - 1
    own = hi >= lo
    # The last end of a text is common; its interval holds the tokens before.
    found = [hi[own]]
    lo, hi = lo[own], hi[own]
    while len(lo):
        inside = hi > lo
        lo, hi = lo[inside], hi[inside]
        cut = np.full(len(lo), -1, np.int64)
        middle, reach = (lo + hi) // 2, 1
        tried_lo, tried_hi = middle.copy(), middle.copy()  # [tried_lo, tried_hi) is done
        open_ = np.arange(len(lo))
        while len(open_):
            new_lo = np.maximum(lo[open_], middle[open_] - reach + 1)
            new_hi = np.minimum(hi[open_], middle[open_] + reach)
            below, above = tried_lo[open_] - new_lo, new_hi - tried_hi[open_]
            places = np.concatenate((scan.ragged(new_lo, below), scan.ragged(tried_hi[open_], above)))
            of = np.concatenate((np.repeat(open_, below), np.repeat(open_, above)))
            at = np.searchsorted(b, a[places])
            hit = b[np.minimum(at, len(b) - 1)] == a[places]
            places, of = places[hit], of[hit]
            nearest = np.lexsort((np.abs(places - middle[of]), of))
            places, of = places[nearest], of[nearest]
            head = np.ones(len(of), bool)
            head[1:] = of[1:] != of[:-1]
            cut[of[head]] = places[head]
            tried_lo[open_], tried_hi[open_] = new_lo, new_hi
            open_ = open_[(cut[open_] < 0) & ((new_lo > lo[open_]) | (new_hi < hi[open_]))]
            reach *= 2
        split = cut >= 0  # the others are leaves
        found.append(cut[split])
        lo, hi = np.concatenate((lo[split], cut[split] + 1)), np.concatenate((cut[split], hi[split]))
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


_DIGITS = 10


@functools.lru_cache(maxsize=1)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 .. n-1, left-aligned, and how many each has."""
    numbers = np.arange(n)
    width = np.maximum(1, np.floor(np.log10(np.maximum(numbers, 1) + 0.5)).astype(np.int64) + 1)
    out = np.zeros((n, _DIGITS), np.uint8)
    for k in range(_DIGITS):
        power = width - 1 - k
        out[:, k] = np.where(power >= 0, numbers // 10 ** np.maximum(power, 0) % 10 + 48, 0)
    return out, width


def written(ids: np.ndarray, marks: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Decimal ids, each followed by its mark, for every text; the last mark of a text is left out."""
    digits, width = _decimals(1 << max(16, int(ids.max()).bit_length() if len(ids) else 0))
    size = width[ids] + 1
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    start = ends - size
    for k in range(int(size.max()) - 1 if len(size) else 0):
        some = size > k + 1
        out[start[some] + k] = digits[ids[some], k]
    out[ends - 1] = marks
    edge = np.concatenate(([0], ends))[first]
    return [out[p : max(p, q - 1)].tobytes() for p, q in zip(edge.tolist(), edge[1:].tolist())]


def _without(ids: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the kept texts; the others have none."""
    count = np.where(keep, np.diff(first), 0)
    return ids[np.repeat(keep, np.diff(first))], np.concatenate(([0], np.cumsum(count)))


def align(
    a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], lengths: tuple[np.ndarray, np.ndarray], sizes: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of the (ids, first tokens) of both tokenizers over texts of ``sizes`` bytes: tokens of A and of B by text, first cuts by
    text, (id of A, id of B) of every cut, and the groups as written."""
    keep = sizes > 1
    for (ids, first), length in zip((a, b), lengths):
        keep &= scan.sums(length[ids], first) == sizes
    (a_ids, a_first), (b_ids, b_first) = (_without(ids, first, keep) for ids, first in (a, b))
    a_end, b_end = np.cumsum(lengths[0][a_ids]), np.cumsum(lengths[1][b_ids])
    cut_a = common_ends(a_end, b_end, a_first)
    cut_b = np.searchsorted(b_end, a_end[cut_a])
    cuts = np.searchsorted(cut_a, a_first)
    # Groups in order: A's ids, then B's, each closed by its mark.
    a_group = np.searchsorted(cut_a, np.arange(len(a_ids)))
    b_group = np.searchsorted(cut_b, np.arange(len(b_ids)))
    a_before = np.concatenate(([0], cut_a + 1))[:-1]
    b_before = np.concatenate(([0], cut_b + 1))[:-1]
    order = np.empty(len(a_ids) + len(b_ids), np.int64)
    marks = np.full(len(order), ord(","), np.uint8)
    a_place = np.arange(len(a_ids)) + (b_before[a_group] if len(a_ids) else 0)
    b_place = np.arange(len(b_ids)) + (cut_a[b_group] + 1 if len(b_ids) else 0)
    order[a_place], order[b_place] = a_ids, b_ids
    marks[a_place[cut_a]], marks[b_place[cut_b]] = ord("|"), ord(";")
    return np.diff(a_first), np.diff(b_first), cuts, np.stack((a_ids[cut_a], b_ids[cut_b])), written(order, marks, a_first + b_first)


# ---- jobs ----


_WORKER: dict[int, tuple] = {}


def _encoders(a_model: str, b_model: bytes) -> tuple[Encoder, Encoder, tuple[np.ndarray, np.ndarray]]:
    """Both encoders of a worker, so that later tasks find its pieces."""
    key = zlib.crc32(a_model.encode(), zlib.crc32(b_model))
    if key not in _WORKER:
        _WORKER.clear()
        kinds, b = pretoken.kinds("tokenizers"), Pieces(b_model)
        one = Encoder(token_ids.library_ids(a_model), lambda data, off: pretoken.split(data, off, kinds))
        _WORKER[key] = (one, Encoder(b.resolve, before_spaces), (byte_level_lengths(a_model), b.lengths))
    return _WORKER[key]


def _aligned(docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, int]:
    """``STAGED`` rows, and the factor of A's id in the number of a pair."""
    spark = docs.sparkSession
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        models = spark.sparkContext.broadcast((f.read(), g.read()))
    factor = len(Pieces(models.value[1]).lengths)
    narrow = len(byte_level_lengths(models.value[0])) * factor <= 1 << 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        one, two, lengths = _encoders(*models.value)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo, hi, data, off in scan.chunks(batch.column(1)):
                texts = np.insert(data, off[:-1], np.uint8(32))
                at = off + np.arange(len(off))
                n_a, n_b, cuts, pair, groups = align(one.encode(texts, at), two.encode(texts, at), lengths, np.diff(at))
                numbers = (pair[0].astype(np.uint64) * np.uint64(factor) + pair[1]).astype("<u4" if narrow else "<u8")
                names = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
                columns = [pa.array(row + np.arange(hi - lo)), batch.column(0).slice(lo, hi - lo), *map(pa.array, (n_a, n_b, np.diff(cuts)))]
                columns += [pa.array(names, pa.string()), pieces.binary(numbers, cuts)]
                row += hi - lo
                yield pa.RecordBatch.from_arrays(columns, STAGED.replace(",", "").split()[::2])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, STAGED), factor


def _numbers(column: pa.Array, rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All pair numbers of a batch and the first of each row; ``rows`` says how many each has."""
    raw, off = scan.utf8(column)
    n = np.concatenate(([0], np.cumsum(rows.to_numpy())))
    width = len(raw) // int(n[-1]) if n[-1] else 4
    return raw.view(f"<u{width}").astype(np.int64), n


def pair_counts(staged: DataFrame, factor: int, counted: int = COUNTED) -> DataFrame:
    """(pair, n, best): links of every pair of ids, and whether no other pair with B's id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])
        for batch in batches:
            numbers, _ = _numbers(batch.column(1), batch.column(0))
            for lo in range(0, len(numbers), 1 << 18):
                own, times = np.unique(numbers[lo : lo + (1 << 18)], return_counts=True)
                pair, back = np.unique(np.concatenate((pair, own)), return_inverse=True)
                n = np.bincount(back, np.concatenate((n, times)), len(pair)).astype(np.int64)
                if len(pair) > counted:
                    yield out()
                    pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield out()

    counts = durable(staged.select("n_groups", "links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.pmod(F.col("pair"), F.lit(factor)).alias("b")
    most = F.broadcast(counts.groupBy(b).agg(F.max("n").alias("most")))  # as many rows as B has ids
    return counts.withColumn("b", b).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _least_of_head(counts: DataFrame, head: int) -> int:
    """The least count such that at most ``head`` pairs reach it. Some hundred rows reach the driver."""
    level = F.floor(F.log2("n") * 16).cast("long")
    rows = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).collect()
    total, least = 0, (1 << 63) - 1
    for r in sorted(rows, key=lambda r: -r["level"]):
        total += r["pairs"]
        if total > head:
            break
        least = r["least"]
    return least


def alignments(docs: DataFrame, a_path: str, b_path: str, head: int = HEAD, path: str | None = None) -> DataFrame:
    """``RESULT`` for every row of ``docs``."""
    spark = docs.sparkSession
    folder = path or fresh_path(spark, "alignment")
    aligned, factor = _aligned(docs, a_path, b_path)
    aligned.write.option("compression", "zstd").parquet(f"{folder}/links")
    staged = spark.read.parquet(f"{folder}/links")
    pair_counts(staged, factor).write.option("compression", "zstd").parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    least = _least_of_head(counts, head)
    top = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    known = [top.column(c).to_numpy() for c in ("pair", "n", "best")]
    table = spark.sparkContext.broadcast((scan.HashTable(known[0].view(np.uint64)), known[1], known[2].astype(np.int64)))
    scored_schema = RESULT + ", row long, pairs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, n, best = table.value
        for batch in batches:
            own = dict(zip(batch.schema.names, batch.columns))
            numbers, first = _numbers(own["links"], own["n_groups"])
            at = index.find(numbers.view(np.uint64))
            held = at >= 0
            got = np.where(held, at, 0)
            rare = np.concatenate(([0], np.cumsum(~held)))[first]
            for name, x in (("n_best", best), ("count_sum", n)):
                own[name] = pa.array(scan.sums(np.where(held, x[got], 0) if len(x) else np.zeros(len(got), np.int64), first))
            own["n_links"] = own["n_groups"]
            own["pairs"] = pa.ListArray.from_arrays(pa.array(rare, pa.int32()), pa.array(numbers[~held]))
            names = [c.split()[0] for c in scored_schema.split(", ")]
            yield pa.RecordBatch.from_arrays([own[c] for c in names], names)

    scored = staged.mapInArrow(run, scored_schema)
    result = RESULT.replace(",", "").split()[::2]
    if counts.where(F.col("n") < least).isEmpty():
        return scored.select(*result)
    scored = durable(scored)
    rare = scored.select("row", F.explode("pairs").alias("pair")).groupBy("row", "pair").agg(F.count(F.lit(1)).alias("times"))
    found = rare.join(counts.where(F.col("n") < least), "pair")
    best = F.when(F.col("best"), F.col("times")).otherwise(0)
    more = found.groupBy("row").agg(F.sum(best).alias("best"), F.sum(F.col("times") * F.col("n")).alias("sum"))
    total = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    joined = scored.drop("pairs").join(more, "row", "left").withColumns({"n_best": total("n_best", "best"), "count_sum": total("count_sum", "sum")})
    return joined.select(*result)
