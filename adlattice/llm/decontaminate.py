"""Removal of benchmark passages from training text.

The normalised items form one generalised suffix automaton over word numbers. The words of a document run through it;
at every word the automaton knows the longest item passage that ends there. Where that is at least a window long, the
window is in the item, and the state that the window leads to knows all items with it.

A document's words reach the automaton only where they may matter: neighbouring words must be neighbours in some item.
That test is one lookup per word pair for whole chunks, and drops no occurrence, as a window consists of such pairs.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.

Items are dealt to automata of at most ``AUTOMATON_WORDS`` words each (a bound on what is broadcast, some 350 bytes a word, 70 MB). Every text is held
once with the ids of its items, or, where there are more than ``IDS_AT_ONCE`` ids, once for each part of them. The documents
are scanned once per automaton, unchanged, and the hits of a document united before anything is counted or cut.

Defined results: null texts and texts without words have no words and no hits; items without words are ignored; an item_id
may be null (it counts as "" in lists) or repeat (it counts once); rows with the same doc_id are judged one by one; an empty
benchmark leaves everything as it is; other columns are ignored by ``find_hits`` and kept by ``remove_passages``.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.llm import scan
from adlattice.session import fresh_path

WINDOW = 10
AUTOMATON_WORDS = 200_000
IDS_AT_ONCE = 1_000_000
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Automaton:
    """Generalised suffix automaton of items (sequences of word hashes) with the items of every window."""

    def __init__(self, items: list[tuple[str | list[str], np.ndarray]], window: int):
        self.window = window
        items = [([name] if isinstance(name, str) else name, hashes) for name, hashes in items if len(hashes)]
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        sequences = [(names, np.searchsorted(self.vocabulary, h).tolist()) for names, h in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        # Tasks get flat tables: one of all transitions, by state and word, and arrays of numbers.
        self.words = max(1, len(self.vocabulary))
        self.edges = {state * self.words + word: to for state, own in enumerate(self.next) for word, to in own.items()}
        self.link, self.length = array("q", self.link), array("q", self.length)
        del self.next
        # Items of a window, by the state that the window leads to and the window's length.
        found: dict[int, set[str]] = {}
        self.short: list[int] = []
        for names, sequence in sequences:
            size = min(window, len(sequence))
            if size < window:
                self.short.append(size)
            state = length = 0
            for word in sequence:
                state, length = self.step(state, length, word)
                if length >= size:
                    found.setdefault(self.ancestor(state, size) * (window + 1) + size, set()).update(names)
        alike: dict[frozenset[str], frozenset[str]] = {}
        self.items = {at: alike.setdefault(own, own) for at, own in ((at, frozenset(own)) for at, own in found.items())}
        self.short = sorted(set(self.short))
        pairs = [s[i] * len(self.vocabulary) + s[i + 1] for _, s in sequences for i in range(len(s) - 1)]
        self.pairs = np.unique(np.array(pairs, np.int64))
        self.single = np.unique(np.array([s[0] for _, s in sequences if len(s) == 1], np.int64))

    def _extend(self, last: int, word: int) -> int:
        held = self.next[last].get(word)
        if held is not None:
            return held if self.length[held] == self.length[last] + 1 else self._split(last, word, held)
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of state q for the passages that are no longer than those of p with the word."""
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """The longest item passage that ends with the word, from the one that ended before it."""
        edges, words = self.edges, self.words
        while state and state * words + word not in edges:
            state = self.link[state]
            length = self.length[state]
        after = edges.get(state * words + word)
        return (0, 0) if after is None else (after, length + 1)

    def ancestor(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a passage that leads to ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def matches(self, sequence: list[int]) -> Iterator[tuple[int, int, frozenset[str]]]:
        """(last word, size, items) of every window in a sequence of word numbers, -1 for words of no item."""
        state = length = 0
        sizes = [*self.short, self.window]
        for at, word in enumerate(sequence):
            state, length = self.step(state, length, word) if word >= 0 else (0, 0)
            for size in sizes:
                if length < size:
                    break
                items = self.items.get(self.ancestor(state, size) * (self.window + 1) + size)
                if items:
                    yield at, size, items

    def candidates(self, numbers: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and ends of the stretches in which a window may stand."""
        shortest = self.short[0] if self.short else self.window
        if len(numbers) == 0 or len(self.vocabulary) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = numbers >= 0
        paired = np.zeros(len(numbers), bool)  # with the word before, of the same text
        near = np.flatnonzero(known[1:] & known[:-1] & (owner[1:] == owner[:-1])) + 1
        key = numbers[near - 1] * len(self.vocabulary) + numbers[near]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            paired[near[self.pairs[at] == key]] = True
        begins = np.flatnonzero(known & ~paired)
        stop = np.flatnonzero(np.append(~paired[1:], True) & known) + 1
        size = stop - begins
        keep = size >= max(2, shortest)
        if shortest == 1:
            keep |= (size == 1) & np.isin(numbers[begins], self.single)
        return begins[keep], stop[keep]


def item_words(text: str | None) -> np.ndarray:
    data, off = scan.utf8(pa.array([text], pa.string()))
    return scan.words(data, off, scan.ALNUM)[0]


def listed(benchmark: DataFrame, ids_at_once: int | None = None) -> DataFrame:
    """(text, part, names) of all items: every text once with its ids, or once for each part of them; written."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.col("text").cast("string"))
    items = items.where("text IS NOT NULL")
    parts = max(1, -(-items.count() // (ids_at_once or IDS_AT_ONCE)))
    path = fresh_path(benchmark.sparkSession, "benchmark")
    part = F.pmod(F.xxhash64("name"), F.lit(parts)).alias("part")
    items.groupBy("text", part).agg(F.collect_set("name").alias("names")).write.parquet(path)
    return benchmark.sparkSession.read.parquet(path)


def item_groups(items: DataFrame, most_words: int = AUTOMATON_WORDS) -> int:
    """Number of automata: a word and its border take two characters at least, an id counts with its characters."""
    size = F.length("text") + F.aggregate("names", F.lit(0), lambda n, name: n + F.length(name))
    return max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // (2 * most_words)))


def automata(items: DataFrame, groups: int, window: int = WINDOW) -> Iterator[Automaton]:
    """Automata that together hold all items; only one group of items is in the driver at a time."""
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("text", "part"), F.lit(groups)) == g).collect()
        yield Automaton([(row["names"], item_words(row["text"])) for row in rows], window)


def _scan(table: pa.Array, automaton: Automaton, known: scan.HashTable):
    """Per chunk: rows, bytes, word starts and ends, first words, hit words, and the items of each text."""
    for lo, hi, data, off in scan.chunks(table):
        hashes, starts, ends, first = scan.words(data, off, scan.ALNUM)
        numbers = known.find(hashes)
        begins, stops = automaton.candidates(numbers, scan.owners(first))
        hit = np.zeros(len(hashes) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for a, b in zip(begins.tolist(), stops.tolist()):
            doc = int(np.searchsorted(first, a, "right")) - 1
            for at, size, names in automaton.matches(numbers[a:b].tolist()):
                hit[a + at - size + 1] += 1
                hit[a + at + 1] -= 1
                items.setdefault(doc, set()).update(names)
        yield lo, hi, data, off, starts, ends, first, np.cumsum(hit[:-1]) > 0, items


def _found(docs: DataFrame, automaton: Automaton, every: bool = True) -> DataFrame:
    """(row, n_words, hits, items): numbers of the hit words and names of the items, of every row or of those with hits."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        known = scan.HashTable(automaton.vocabulary)
        for batch in batches:
            for lo, hi, _, _, _, _, first, hit, items in _scan(batch.column(1), automaton, known):
                told = list(range(hi - lo)) if every else sorted(items)
                places = [np.flatnonzero(hit[first[k] : first[k + 1]]) if k in items else () for k in told]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).take(pa.array(told, pa.int64())),
                        pa.array(np.diff(first)[told] if told else np.zeros(0, np.int64)),
                        pa.array(places, pa.list_(pa.int32())),
                        pa.array([sorted(items.get(k, ())) for k in told], pa.list_(pa.string())),
                    ],
                    ["row", "n_words", "hits", "items"],
                )

    schema = f"row {docs.schema['row'].dataType.simpleString()}, n_words long, hits array<int>, items array<string>"
    return docs.mapInArrow(run, schema)


def _united(rows: DataFrame, items: DataFrame, groups: int, window: int) -> DataFrame:
    """(row, n_words, hits, items) of (row, text) over all automata; rows need names of their own."""
    spark, path = rows.sparkSession, fresh_path(rows.sparkSession, "decontaminate-hits")
    for k, automaton in enumerate(automata(items, groups, window)):
        _found(rows, automaton, k == 0).write.parquet(f"{path}/part={k}")
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return spark.read.parquet(path).groupBy("row").agg(F.first("n_words").alias("n_words"), every("hits"), every("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """(doc_id, n_words, hits, items) of every row of ``docs``."""
    spark, items = docs.sparkSession, listed(benchmark)
    groups = item_groups(items, most_words)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if groups == 1:
        (automaton,) = automata(items, 1, window)
        found = _found(plain.select(F.col("doc_id").alias("row"), "text"), automaton)
        return found.withColumnRenamed("row", "doc_id")
    # Rows need names of their own for the union; these are written, so that all scans see the same.
    path = fresh_path(spark, "decontaminate")
    plain.select(F.struct("doc_id", F.monotonically_increasing_id().alias("at")).alias("row"), "text").write.parquet(path)
    return _united(spark.read.parquet(path), items, groups, window).select("row.doc_id", "n_words", "hits", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_words: int = AUTOMATON_WORDS) -> DataFrame:
    """Counts and digests of the hits of every row of ``docs``."""
    found = find_hits(docs, benchmark, window, most_words)
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_coverage: float = 0.5, most_words: int = AUTOMATON_WORDS
) -> DataFrame:
    """``docs`` without hit words and without rows whose hit share of words is above ``most_coverage``.

    A removed passage goes from its first byte to the start of the next kept word; texts without hits stay as they are.
    """
    spark, names, items = docs.sparkSession, docs.columns, listed(benchmark)
    text, groups = names.index("text"), item_groups(items, most_words)
    if groups == 1:
        shared = spark.sparkContext.broadcast(next(automata(items, 1, window)))

        def marked(batch: pa.RecordBatch, known: list[scan.HashTable]):
            if not known:
                known.append(scan.HashTable(shared.value.vocabulary))
            for lo, _, data, off, starts, _, first, hit, found in _scan(batch.column(text), shared.value, known[0]):
                yield lo, data, off, starts, first, hit, found

        return docs.mapInArrow(_remover(marked, names, text, most_coverage), docs.schema)
    at = "_at" + "_" * sum(map(len, names))
    path = fresh_path(spark, "decontaminate")
    docs.withColumn(at, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    found = _united(rows.select(F.col(at).alias("row"), F.col("text").cast("string")), items, groups, window)
    hits = found.where(F.size("hits") > 0).select(F.col("row").alias(at), F.col("hits").alias(at + "_"))
    whole = rows.join(hits, at, "left").select(*[F.col(f"`{c}`") for c in names], at + "_")

    def placed(batch: pa.RecordBatch, _):
        places = batch.column(len(names))
        for lo, hi, data, off in scan.chunks(batch.column(text)):
            _, starts, _, first = scan.words(data, off, scan.ALNUM)
            own = places.slice(lo, hi - lo)
            some = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False)).tolist()
            hit = np.zeros(len(starts), bool)
            for k in some:
                hit[first[k] + own[k].values.to_numpy()] = True
            yield lo, data, off, starts, first, hit, some

    return whole.mapInArrow(_remover(placed, names, text, most_coverage), docs.schema)


def _remover(marked, names: list[str], text: int, most_coverage: float):
    """Cuts what ``marked`` finds in a batch: per chunk its first row, bytes, word starts, first words, hit words, texts with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list = []
        for batch in batches:
            changed, keep = {}, np.ones(batch.num_rows, bool)
            for lo, data, off, starts, first, hit, found in marked(batch, known):
                for k in found:
                    a, b = int(first[k]), int(first[k + 1])
                    marks = hit[a:b]
                    if marks.mean() > most_coverage:
                        keep[lo + k] = False
                        continue
                    edges = np.append(starts[a:b], off[k + 1])
                    edges[0] = off[k]
                    gone = np.repeat(marks, np.diff(edges))
                    changed[lo + k] = data[off[k] : off[k + 1]][~gone].tobytes().decode()
            columns = list(batch.columns)[: len(names)]
            if changed:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(changed)] = True
                fresh = pa.array([changed[k] for k in sorted(changed)], columns[text].type)
                columns[text] = pc.replace_with_mask(columns[text], pa.array(mask), fresh)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep))

    return run
