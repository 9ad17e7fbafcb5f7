"""Language-model scores of a probabilistic suffix tree over words.

Symbols are lower-cased words and one end per text. The root is the distribution (c + 1) / (N + V + 1) of single symbols.
A context is up to ``DEPTH`` symbols before the next one. Level by level, all contexts are examined that occur ``MIN_COUNT``
times or more in the training rows; a context is kept where its next-symbol distribution diverges from that of its
longest kept suffix by ``MIN_DIVERGENCE`` nats or more. A kept context stores the next symbols seen ``MIN_STORED`` times
or more; their probability is (n + MU * p) / (total + MU), with p from the longest kept suffix.
What is left goes to all other symbols in proportion to p, so every distribution adds up to 1. A symbol of a text is
scored by the longest kept suffix of what stands before it.

Sizes. The counts that decide are absolute, so the tree grows with the corpus. Its levels are tables: next symbols with their
counts and probabilities, and contexts with their totals. A level is made from the one before by joins on (suffix, symbol); what a
context's symbols have in its longest kept suffix stands in the row of its suffix, so no task follows a chain. Tasks know the most frequent
contexts of a level (``FEW_CONTEXTS``) and words (``HEAD``) and number the pairs of these; sorted numbers of pairs meet in buckets whose number grows
with the corpus. A ``Filter`` tells of other pairs whether their context and word may count; these are sent by their keys, packed, to buckets
of their own, and the joins of the level leave out what the filter let through wrongly.

A score is that of the root and a sum over kept contexts and their symbols: a context adds ``rest``, a symbol stored there adds ``more``,
what then lacks to its probability. So each context and each symbol counts for itself, wherever it is held. The most frequent (``HOT``) are
broadcast; of the others, which are rarely met, tasks know a filter, and what passes it is sent to buckets of the tables, packed with the
place of its row, and comes back as sums by row.

Contexts and their next symbols are made of all words seen ``MIN_COUNT`` times or more. Word counts grow with the corpus too: the HEAD most frequent
words are broadcast. All other words stay in a table. Each adds a known amount plus log10(c + 1), and these are joined by word and added up by text.

Defined results: a null text is an empty one and has its end alone; rows with the same doc_id, or none, are scored one by
one; with a null doc_id a row is in the training part; without training rows N = V = 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.llm import pieces, scan
from adlattice.session import fresh_path

DEPTH = 3
MIN_COUNT = 16
MIN_STORED = 4
MIN_DIVERGENCE = 0.02
MU = 1.0
HEAD = 1 << 20
#: The end's place among word hashes; that a word has this hash is as unlikely as any collision.
END = np.uint64(0x5851F42D4C957F2D)
#: Contexts of a level that tasks may know (16 bytes each, and their table).
FEW_CONTEXTS = 1 << 20
#: Contexts and stored symbols that are sent to every task for scoring (some 20 bytes each).
HOT = 8_000_000
#: 64-bit words of a filter at most; up to that, one for every 4 keys.
FILTER_WORDS = 1 << 22
#: Pairs of all tasks that meet in a bucket, about.
BUCKET = 1 << 20
#: Symbols that a task holds before it counts them.
HELD = 1 << 21

RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def held_out(ids: pa.Array) -> np.ndarray:
    """Rows that nothing is learnt from."""
    return scan.crc_of_id(ids) % 7 == 2


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts of a chunk, ends included, and the n + 1 numbers of each text's first symbol."""
    hashes, _, _, first = scan.words(data, off, scan.SOLID)
    return np.insert(hashes, first[1:], END), first + np.arange(len(first))


def _training(batches: Iterator[pa.RecordBatch], skip: Callable[[pa.Array], np.ndarray]):
    for batch in batches:
        kept = pa.array(~skip(batch.column(0)))
        for lo, hi, *_ in scan.chunks(batch.column(1)):
            # Rows are left out chunk by chunk, as the rest of a batch is a copy.
            yield symbols(*scan.utf8(batch.column(1).slice(lo, hi - lo).filter(kept.slice(lo, hi - lo))))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def tallied(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different values of several arrays in ascending order, and how often each occurs; the list is emptied."""
    whole = np.concatenate(parts)
    parts.clear()
    whole.sort()
    first = np.flatnonzero(np.concatenate(([True], whole[1:] != whole[:-1])) if len(whole) else np.zeros(0, bool))
    return whole[first], np.diff(first, append=len(whole))


def count_symbols(docs: DataFrame, skip: Callable[[pa.Array], np.ndarray] = held_out) -> DataFrame:
    """(symbol, n) over the training rows, as signed 64-bit hashes."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, n = tallied(parts)
        return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["symbol", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for own, _ in _training(batches, skip):
            parts.append(own)
            size += len(own)
            if size >= HELD:
                yield counted(parts)
                size = 0
        if parts:
            yield counted(parts)

    return _plain(docs).mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


@dataclass
class Tree:
    """The root, and the tables of kept contexts (context, size, rest) and of their symbols (context, symbol, n, more)."""

    n: int
    v: int
    head: np.ndarray
    head_counts: np.ndarray
    #: Whether the head has all words that contexts are made of.
    whole_head: bool = True
    contexts: DataFrame | None = None
    pairs: DataFrame | None = None

    def logs_of(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.n + self.v + 1))


def context_keys(own: np.ndarray, first: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each depth: (places with so many symbols of the text before them, keys of these contexts)."""
    n = len(own)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    key = np.zeros(n, np.uint64)
    for d in range(1, depth + 1):
        at = np.flatnonzero(place >= d)
        key[at] = extended(key[at], own[at - d])
        yield at, key[at]


def extended(key: np.ndarray, older: np.ndarray) -> np.ndarray:
    """Key of a context with one more symbol at its old end."""
    return scan.mix(key * np.uint64(0xD6E8FEB86659FD93) + older)


def _pair(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return scan.mix(context ^ scan.mix(symbol + np.uint64(1)))


class Numbers:
    """Numbers of (context, symbol) pairs, scrambled one to one so that any of them fill buckets alike.

    The bucket is the upper part of a number; what is left fits 32 bits.
    """

    def __init__(self, contexts: int, symbols: int, expected: int):
        self.symbols = symbols
        self.bits = max(1, int(contexts * symbols).bit_length())
        self.low = max(0, min(32, self.bits - max(0, (expected // BUCKET)).bit_length()))
        self.mask = np.uint64((1 << self.bits) - 1)
        self.factor = np.uint64(0x9E3779B97F4A7C15 & ((1 << self.bits) - 1) | 1)
        self.inverse = np.uint64(pow(int(self.factor), -1, 1 << self.bits))

    def of(self, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return (context.astype(np.uint64) * np.uint64(self.symbols) + symbol.astype(np.uint64)) * self.factor & self.mask

    def parts(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = number * self.inverse & self.mask
        return (plain // np.uint64(self.symbols)).astype(np.int64), (plain % np.uint64(self.symbols)).astype(np.int64)


@dataclass(eq=False)
class Filter:
    """Which keys a table has: four bits for each in one of 2^n words. A few other keys pass, none of the table's is stopped."""

    words: np.ndarray

    def passes(self, keys: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(keys), np.uint64)
        for shift in (0, 6, 12, 18):
            mask |= np.uint64(1) << (keys >> np.uint64(shift) & np.uint64(63))
        return self.words[keys >> np.uint64(65 - len(self.words).bit_length())] & mask == mask


def key_filter(table: DataFrame, key: str) -> Filter:
    """The filter of a column of mixed 64-bit keys; only its words reach the driver."""
    bits = max(1, min((table.count() // 4).bit_length(), FILTER_WORDS.bit_length() - 1))
    mask = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({key}, {shift}) & 63 AS int))" for shift in (0, 6, 12, 18))
    found = table.select(F.expr(f"shiftrightunsigned({key}, {64 - bits})").alias("at"), F.expr(mask).alias("mask"))
    got = found.groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(1 << bits, np.uint64)
    words[got.column("at").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    return Filter(words)


def least_of(table: DataFrame, count: str, most: int) -> int:
    """A bound that ``most`` rows at most reach, and as many as steps of a sixteenth of an octave allow; 0 if all may."""
    step = F.floor(F.log2(count) * 16).cast("long")
    steps = table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.min(count).alias("least")).collect()
    total, least = 0, 1 << 62
    for r in sorted(steps, key=lambda r: -r["step"]):
        total += r["rows"]
        if total > most:
            return least
        least = r["least"]
    return 0


def _buckets(sorted_keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The upper bits of ascending keys: the different ones, and where each begins (and the end)."""
    bucket = (sorted_keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
    return bucket[edges[:-1]], edges


def _array(column, kind: str) -> np.ndarray:
    """All values of a column of packed binaries."""
    return scan.utf8(column)[0].view(kind)


_NEXT = "context long, symbol long, n long"


def _next_of_known(
    docs: DataFrame,
    keys: np.ndarray,
    frequent: np.ndarray,
    depth: int,
    least: int,
    symbols_in_all: int,
    skip: Callable[[pa.Array], np.ndarray],
    other_keys: Filter | None = None,
    other_words: Filter | None = None,
) -> DataFrame:
    """(context, symbol, n) with n of ``least`` or more; tasks know the contexts and words, and filters of others.

    Pairs with such others may have a context or word that isn't meant, which passed the filter.
    """
    shared = docs.sparkSession.sparkContext.broadcast((keys, frequent, other_keys, other_words))
    numbers = Numbers(len(keys), len(frequent), symbols_in_all)
    far_bits = max(1, (symbols_in_all // (2 * BUCKET)).bit_length())
    names = ["bucket", "low", "n", "contexts", "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, frequent, other_keys, other_words = shared.value
        contexts, known, parts, size, far, far_size = scan.HashTable(keys), scan.HashTable(frequent), [], 0, [], 0

        def counted() -> pa.RecordBatch:
            number, n = tallied(parts)
            if n.max() > 65535:
                # A count is written in pieces of 16 bits.
                parted = -(-n // 65535)
                last = n - 65535 * (parted - 1)
                number, n = np.repeat(number, parted), np.full(int(parted.sum()), 65535)
                n[np.cumsum(parted) - 1] = last
            bucket = (number >> np.uint64(numbers.low)).astype(np.int64)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
            low = (number & np.uint64((1 << numbers.low) - 1)).astype("<u4")
            none = pa.nulls(len(edges) - 1, pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[edges[:-1]]), pieces.binary(low, edges), pieces.binary(n.astype("<u2"), edges), none, none], names
            )

        def far_counted() -> pa.RecordBatch:
            context, symbol = (np.concatenate(x) for x in zip(*far))
            far.clear()
            context, symbol, n = _summed(context, symbol, np.ones(len(context), np.int64))
            bucket, edges = _buckets(_pair(context, symbol), far_bits)
            packed = [pieces.binary(x, edges) for x in (n.astype("<u4"), context, symbol)]
            return pa.RecordBatch.from_arrays([pa.array(-1 - bucket), pa.nulls(len(bucket), pa.binary()), *packed], names)

        for own, first in _training(batches, skip):
            *_, (at, key) = context_keys(own, first, depth)
            context, symbol = contexts.find(key), known.find(own[at])
            named, said = context >= 0, symbol >= 0
            hit = np.flatnonzero(named & said)
            parts.append(numbers.of(context[hit], symbol[hit]))
            size += len(hit)
            if size >= HELD:
                yield counted()
                size = 0
            if other_keys is None and other_words is None:
                continue
            some = np.flatnonzero(~(named & said))
            for held, among, values in ((named, other_keys, key), (said, other_words, own[at])):
                some = some[held[some] | (among.passes(values[some]) if among else False)]
            far.append((key[some], own[at[some]]))
            far_size += len(some)
            if far_size >= HELD // 2:
                yield far_counted()
                far_size = 0
        if size:
            yield counted()
        if far_size:
            yield far_counted()

    def merge(table: pa.Table) -> pa.Table:
        keys, frequent, *_ = shared.value
        bucket = table.column("bucket")[0].as_py()
        if bucket < 0:
            context, symbol, total = _summed(*(_array(table.column(c), kind) for c, kind in (("contexts", "<u8"), ("symbols", "<u8"), ("n", "<u4"))))
            often = total >= least
            columns = [context[often].view(np.int64), symbol[often].view(np.int64), total[often]]
            return pa.table(dict(zip(("context", "symbol", "n"), columns)))
        low = _array(table.column("low"), "<u4")
        order = np.argsort(low, kind="stable")
        number = low[order]
        first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        number, total = number[first], np.add.reduceat(_array(table.column("n"), "<u2")[order], first, dtype=np.int64)
        often = total >= least
        context, symbol = numbers.parts(number[often].astype(np.uint64) + (np.uint64(bucket) << np.uint64(numbers.low)))
        columns = [keys[context].view(np.int64), frequent[symbol].view(np.int64), total[often]]
        return pa.table(dict(zip(("context", "symbol", "n"), columns)))

    sent = _plain(docs).mapInArrow(run, "bucket long, low binary, n binary, contexts binary, symbols binary")
    return sent.groupBy("bucket").applyInArrow(merge, _NEXT)


def _summed(context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs in the order of their keys, and the sum of n of each."""
    pair = _pair(context, symbol)
    order = np.argsort(pair)
    pair = pair[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(pair)), bool), pair[1:] != pair[:-1])))
    total = np.add.reduceat(n[order], first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    return context[order[first]], symbol[order[first]], total


_CONTEXTS = "context long, suffix long, size long, members array<long>"


def _longer(rows: DataFrame, contexts: DataFrame, least: int) -> DataFrame:
    """Contexts of the next level: those of this one with a symbol behind, as often as that symbol was seen there."""
    more = _words(rows.where(F.col("n") >= least))
    return _keyed(more.join(contexts.select("context", "members"), "context").select("n", F.concat(F.array("symbol"), "members").alias("members")))


def _words(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("symbol") != F.lit(int(END.view(np.int64))))


def _keyed(told: DataFrame) -> DataFrame:
    """Contexts of (n, members) rows with their keys and those of their suffixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).view(np.uint64)
            key = np.zeros(len(words), np.uint64)
            for back in range(words.shape[1]):
                suffix, key = key, extended(key, words[:, back])
            columns = [pa.array(key.view(np.int64)), pa.array(suffix.view(np.int64)), batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["context", "suffix", "size", "members"])

    return told.mapInArrow(run, _CONTEXTS)


def grow(
    docs: DataFrame,
    counts: DataFrame,
    depth: int = DEPTH,
    min_count: int = MIN_COUNT,
    min_stored: int = MIN_STORED,
    min_divergence: float = MIN_DIVERGENCE,
    mu: float = MU,
    head: int = HEAD,
    few: int = FEW_CONTEXTS,
    skip: Callable[[pa.Array], np.ndarray] = held_out,
) -> Tree:
    """The tree of the training rows; ``counts`` is what ``count_symbols`` found, written."""
    if min_stored > min_count:
        raise ValueError("contexts of the next level are found among the stored symbols")
    spark, folder = docs.sparkSession, fresh_path(docs.sparkSession, "contexts")

    def save(frame: DataFrame, name: str) -> DataFrame:
        frame.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    able = counts.where(F.col("n") >= min_count)
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") >= min_count).alias("able")).first()
    n, v = total["n"] or 0, total["v"]
    whole_head = total["able"] <= head
    least_held = min(max(1, -(-n // head)), min_count) if whole_head else least_of(counts, "n", head)
    top = counts.where(F.col("n") >= least_held).toArrow()
    keys, values = top.column("symbol").to_numpy().view(np.uint64), top.column("n").to_numpy()
    tree = Tree(n, v, keys, values, whole_head)
    frequent = keys[values >= min_count]
    other_words = None if whole_head else key_filter(able.where(F.col("n") < least_held), "symbol")
    if _words(able).isEmpty():
        return tree
    before = able.select(F.lit(0).cast("long").alias("context"), "symbol", ((F.col("n") + 1) / F.lit(float(n + v + 1))).alias("p"))
    contexts = save(_keyed(_words(able).select("n", F.array("symbol").alias("members"))), "contexts-1")
    for level in range(1, depth + 1):
        examined = contexts.count()
        if not examined:
            break
        # Tasks know the most frequent contexts, and a filter of the others.
        bound = 0 if examined <= few else least_of(contexts, "size", few)
        own = np.sort(contexts.where(F.col("size") >= bound).select("context").toArrow().column(0).to_numpy().view(np.uint64))
        others = key_filter(contexts.where(F.col("size") < bound), "context") if bound else None
        found = _next_of_known(docs, own, frequent, level, min_stored, n, skip, others, other_words)
        rows = save(found, f"next-{level}")
        following = save(_longer(rows, contexts, min_count), f"contexts-{level + 1}") if level < depth else None
        # Probabilities of the symbols by the longest kept suffix stand in the suffix's rows.
        told = rows.join(contexts.select("context", "suffix", "size"), "context")
        suffix = before.select(F.col("context").alias("suffix"), "symbol", F.col("p").alias("below"))
        stored = told.join(suffix, ["suffix", "symbol"]).withColumn("stored", (F.col("n") + mu * F.col("below")) / (F.col("size") + mu))
        stored = save(stored.select("context", "symbol", "size", "n", "below", "stored"), f"stored-{level}")
        least = F.lit(1e-12)
        judged = stored.groupBy("context").agg(
            F.greatest(1 - F.sum("stored"), least).alias("left"),
            F.greatest(1 - F.sum("below"), least).alias("room"),
            F.sum(F.col("stored") * F.log(F.col("stored") / F.col("below"))).alias("gain"),
            F.max("size").alias("size"),
        )
        kept = judged.where(F.col("gain") + F.col("left") * F.log(F.col("left") / F.col("room")) >= min_divergence)
        kept = save(kept.select("context", "size", F.log10(F.col("left") / F.col("room")).cast("float").alias("rest")), f"kept-{level}")
        more = F.log10("stored") - F.log10("below") - F.col("rest")
        pairs = stored.join(kept.select("context", "rest"), "context").select("context", "symbol", "n", more.alias("more"))
        pairs = save(pairs, f"pairs-{level}")
        tree.contexts = kept if tree.contexts is None else tree.contexts.unionByName(kept)
        tree.pairs = pairs if tree.pairs is None else tree.pairs.unionByName(pairs)
        if following is None:
            break
        marked = stored.join(kept.select("context", F.lit(True).alias("is_kept")), "context", "left")
        p = F.when(F.col("is_kept"), F.col("stored")).otherwise(F.col("below"))
        before, contexts = save(marked.select("context", "symbol", p.alias("p")), f"p-{level}"), following
    return tree


@dataclass(eq=False)
class Hot:
    """The part of a tree that every task holds: contexts of ``least`` occurrences or more, and symbols stored so often."""

    tree_head: np.ndarray
    head_logs: np.ndarray
    unseen: float
    least: int
    #: Which words of the head contexts are made of; None where a task can't hold all of these.
    able: np.ndarray | None
    #: Keys of contexts and of pairs, ascending as signed numbers, and what each adds.
    keys: np.ndarray
    rest: np.ndarray
    pairs: np.ndarray
    more: np.ndarray
    #: Keys of the contexts and pairs that aren't held.
    others: Filter | None = None


def _paired(pairs: DataFrame) -> DataFrame:
    """(key, more) of (context, symbol, more) rows: one number for each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, symbol = (batch.column(c).to_numpy().view(np.uint64) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(_pair(context, symbol).view(np.int64)), batch.column(2)], ["key", "more"])

    return pairs.select("context", "symbol", "more").mapInArrow(run, "key long, more double")


def hottest(tree: Tree, hot: int, min_count: int) -> Hot:
    """The most frequent contexts and stored symbols of a tree, ``hot`` rows at most. Each counts by its own occurrences."""
    logs, unseen = tree.logs_of(tree.head_counts.astype(np.float64)), float(tree.logs_of(np.zeros(1))[0])
    able = tree.head_counts >= min_count if tree.whole_head else None
    none, zero = np.zeros(0, np.uint64), np.zeros(0)
    if tree.contexts is None:
        return Hot(tree.head, logs, unseen, 0, able, none, zero, none, zero)
    least = least_of(tree.contexts.select(F.col("size").alias("n")).unionByName(tree.pairs.select("n")), "n", hot)

    def told(table: DataFrame) -> list[np.ndarray]:
        got = table.orderBy("key").toArrow()
        return [got.column(c).to_numpy() for c in range(2)]

    # They come in order, as tables of ordered keys are small.
    keys, rest = told(tree.contexts.where(F.col("size") >= least).select(F.col("context").alias("key"), "rest"))
    both, more = told(_paired(tree.pairs.where(F.col("n") >= least)))
    return Hot(tree.head, logs, unseen, least, able, keys.view(np.uint64), rest, both.view(np.uint64), more)


class Scorer:
    def __init__(self, hot: Hot, depth: int):
        # Not the whole of ``hot``, which the worker gives up with its broadcast.
        self.head_logs, self.unseen, self.rest, self.more, self.others, self.depth = hot.head_logs, hot.unseen, hot.rest, hot.more, hot.others, depth
        self.head, self.able = scan.HashTable(hot.tree_head), hot.able
        self.contexts, self.pairs = scan.SortedTable(hot.keys), scan.SortedTable(hot.pairs)

    def score(self, own: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 p at the root and with what the contexts and symbols held here add, the places of symbols beyond the head, and places with
        keys that others may hold, once for each such context and symbol.

        For symbols beyond the head, log10(c + 1) is still to be added to both.
        """
        at = self.head.find(own)
        known = at >= 0
        base = np.where(known, self.head_logs[at] if len(self.head_logs) else 0.0, self.unseen)
        logs, asked = base.copy(), [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]

        def added(table: scan.SortedTable, values: np.ndarray, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
            """Which keys are held here or may be elsewhere."""
            found = table.find(keys)
            held = found >= 0
            logs[places[held]] += values[found[held]]
            if self.others is not None:
                far = np.flatnonzero(~held)
                far = far[self.others.passes(keys[far])]
                asked.append((places[far], keys[far]))
                held[far] = True
            return held

        if self.able is None or self.able.any():
            often = np.ones(len(own), bool) if self.able is None else known & self.able[at]
            for d, (places, keys) in enumerate(context_keys(own, first, self.depth), 1):
                able = often[places - 1]
                for back in range(2, d + 1):
                    able &= often[places - back]
                places, keys = places[able], keys[able]
                held = added(self.contexts, self.rest, places, keys)
                places = places[held]
                added(self.pairs, self.more, places, _pair(keys[held], own[places]))
        return base, logs, np.flatnonzero(~known), *(np.concatenate(x) for x in zip(*asked))


_WORKER: WeakKeyDictionary[Hot, Scorer] = WeakKeyDictionary()


def _worker_scorer(hot: Hot, depth: int) -> Scorer:
    """One scorer per worker and tree; it goes with the broadcast, so that a worker's next job doesn't carry it along."""
    if hot not in _WORKER:
        _WORKER[hot] = Scorer(hot, depth)
    return _WORKER[hot]


def _far_sums(asked: DataFrame, table: DataFrame, bits: int) -> DataFrame:
    """(row, change): what the keys that tasks asked for add to each row.

    ``asked`` has (bucket, row, keys, rows): packed keys, and the number of each one's row behind ``row``. ``table`` has (key, more).
    """

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        keys, more = (table.column(c).to_numpy() for c in ("key", "more"))
        held, rows, sums, size = scan.HashTable(keys.view(np.uint64)), [], [], []
        for some, behind in zip(asked.column("keys"), asked.column("rows")):
            found = held.find(np.frombuffer(some.as_buffer(), "<u8"))
            hit = found >= 0
            row, back = np.unique(np.frombuffer(behind.as_buffer(), "<u4")[hit], return_inverse=True)
            rows.append(row)
            sums.append(np.bincount(back, more[found[hit]], len(row)))
            size.append(len(row))
        edges = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        packed = [pieces.binary(np.concatenate([np.zeros(0, kind), *x]).astype(kind), edges) for x, kind in ((rows, "<u4"), (sums, "<f8"))]
        return pa.table([asked.column("row"), *packed], ["row", "rows", "sums"])

    def total(table: pa.Table) -> pa.Table:
        row, back = np.unique(_array(table.column("rows"), "<u4"), return_inverse=True)
        change = np.bincount(back, _array(table.column("sums"), "<f8"), len(row))
        return pa.table([row.astype(np.int64) + table.column("row")[0].as_py(), change], ["row", "change"])

    dealt = table.withColumn("bucket", F.expr(f"shiftrightunsigned(key, {64 - bits})"))
    answers = asked.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(answer, "row long, rows binary, sums binary")
    return answers.where(F.octet_length("rows") > 0).groupBy("row").applyInArrow(total, "row long, change double")


def score(
    docs: DataFrame,
    tree: Tree,
    counts: DataFrame,
    depth: int = DEPTH,
    min_count: int = MIN_COUNT,
    hot: int = HOT,
    skip: Callable[[pa.Array], np.ndarray] = held_out,
) -> DataFrame:
    """Scores of every row; ``counts`` is the table that the tree was grown from."""
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "suffix-tree")
    held = hottest(tree, hot, min_count)
    far, bits = None, 1
    if held.least:
        contexts = tree.contexts.where(F.col("size") < held.least)
        pairs = tree.pairs.where(F.col("n") < held.least)
        contexts.select(F.col("context").alias("key"), F.col("rest").cast("double").alias("more")).unionByName(_paired(pairs)).write.option("compression", "zstd").parquet(f"{path}/far")
        far = spark.read.parquet(f"{path}/far")
        held.others = key_filter(far, "key")
        # Training rows ask for each so often.
        times = contexts.select(F.col("size").alias("n")).unionByName(pairs.select("n")).agg(F.sum("n")).first()[0]
        bits = max(1, (times // (4 * BUCKET)).bit_length())
    shared = spark.sparkContext.broadcast(held)
    part = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare binary, times binary, bucket long, keys binary, rows binary"
    names = part.replace(",", "").split()[::2]
    texts = _plain(docs).withColumn("row", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, far, size = _worker_scorer(shared.value, depth), [], 0

        def sent() -> pa.RecordBatch:
            keys, rows = (np.concatenate(x) for x in zip(*far))
            far.clear()
            order, lowest = np.argsort(keys), int(rows.min())
            keys, rows = keys[order], (rows[order] - lowest).astype("<u4")
            bucket, edges = _buckets(keys, bits)
            none = [pa.nulls(len(bucket), kind) for kind in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())]
            packed = [pieces.binary(keys, edges), pieces.binary(rows, edges)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(bucket), lowest)), *none, pa.array(bucket), *packed], names)

        for batch in batches:
            out = skip(batch.column(0))
            row = batch.column(2).to_numpy()
            for lo, hi, data, off in scan.chunks(batch.column(1)):
                own, first = symbols(data, off)
                base, logs, rest, places, keys = scorer.score(own, first)
                if len(places):
                    far.append((keys, row[lo + np.searchsorted(first, places, "right") - 1]))
                    size += len(keys)
                    if size >= HELD:
                        yield sent()
                        size = 0
                cuts = np.searchsorted(rest, first)
                rare, times = [], []
                for a, b in zip(cuts, cuts[1:]):
                    words, n = np.unique(own[rest[a:b]], return_counts=True)
                    rare.append(words.astype("<u8").tobytes())
                    times.append(n.astype("<u4").tobytes())
                size_of = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(2).slice(lo, hi - lo),
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(out[lo:hi]),
                        pa.array(size_of),
                        pa.array(size_of - np.diff(cuts)),
                        pa.array(scan.sums(base, first)),
                        pa.array(scan.sums(logs, first)),
                        pa.array(rare, pa.binary()),
                        pa.array(times, pa.binary()),
                        *(pa.nulls(hi - lo, kind) for kind in (pa.int64(), pa.binary(), pa.binary())),
                    ],
                    names,
                )
        if size:
            yield sent()

    texts.mapInArrow(run, part).write.option("compression", "zstd").parquet(f"{path}/scored")
    written = spark.read.parquet(f"{path}/scored")
    rows = written.where(F.col("bucket").isNull()).drop("bucket", "keys", "rows")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, off = scan.utf8(batch.column(1))
            times = _array(batch.column(2), "<u4").astype(np.int64)
            row = np.repeat(batch.column(0).to_numpy(), np.diff(off) // 8)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(words.view("<i8")), pa.array(times)], ["row", "symbol", "times"])

    rare = rows.where(F.octet_length("rare") > 0).select("row", "rare", "times")
    rare = rare.mapInArrow(unpack, "row long, symbol long, times long")
    more = (
        rare.join(counts.select("symbol", "n"), "symbol")
        .groupBy("row")
        .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    )
    scored, change = rows.join(more, "row", "left"), F.lit(0.0)
    if far is not None:
        asked = written.where(F.col("bucket").isNotNull()).select("bucket", "row", "keys", "rows")
        scored = scored.join(_far_sums(asked, far, bits), "row", "left")
        change = F.coalesce("change", F.lit(0.0))
    logs, known = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + known).alias("n_known"),
        F.lit(tree.n).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("score") + logs + change).alias("score"),
    )


def model_scores(docs: DataFrame, hot: int = HOT, depth: int = DEPTH, min_count: int = MIN_COUNT, **settings) -> DataFrame:
    """Learn from the training rows of ``docs`` and score all rows."""
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "symbols")
    count_symbols(docs).write.parquet(path)
    counts = spark.read.parquet(path)
    return score(docs, grow(docs, counts, depth, min_count, **settings), counts, depth, min_count, hot)
