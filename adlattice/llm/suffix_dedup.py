"""Removal of long byte strings that occur more than once in a corpus.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else, in the same text or another. Strings
don't cross texts, and are judged on the input. A place where such a string may start is a window.

Blocks. Every window is named by the least hash among its ``GRAM``-byte strings; equal windows have equal names. Neighbouring
windows of one name form a block of some hundred windows, and a name that occurs in one block of the corpus alone settles
all its windows (unless the name stands twice within a block, as in periodic text). Blocks whose whole strings are equal
settle each other. What remains are the edges of copies: blocks of one name with different strings.

Suffix arrays. These strings are dealt by name into shards of about ``SHARD_BYTES``. Each shard sorts its suffixes by
Larsson-Sadakane refinement (groups equal in the first h bytes are sorted by the groups h and 2 h bytes further on, h triples,
sorted groups drop out), gets common prefixes by Kasai's rule (the next suffix in the text shares one byte less, so only suffixes
whose neighbour isn't the neighbour's successor, or that follow one sharing nothing, are compared), and finds its classes
of equal windows.

Merging. A name with more than ``SPLIT`` different strings, or long ones, is spread over several shards. Each sends its sorted class digests,
cut by digest, and these are looked up in those of the other shards by binary search. The cuts grow in number with the strings.

Passages. A passage of ``PASSAGE`` words may be shorter than ``LENGTH`` bytes. Words that lie in runs of so many words which also
start anywhere else are found by the same steps, with hashes of lower-cased words in place of bytes. They are counted, not removed.

Texts are named by two 64-bit hashes; equal texts have equal results. Defined results: a null text is an empty one; texts
shorter than ``LENGTH`` keep all bytes; rows with the same or no doc_id are judged one by one; a removed run may cut a
multi-byte character, so ``kept`` bytes are binary; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adlattice.llm import scan
from adlattice.session import fresh_path

LENGTH = 400
GRAM = 200
#: The same in words, for passages that are counted only.
PASSAGE = 50
PASSAGE_GRAM = 20
SHARD_BYTES = 1 << 20
SPLIT = 512
#: Shards that a task takes one after another.
TASK_SHARDS = 2
#: Names of texts (two hashes and a doc_id) are broadcast up to this many rows (some 30 MB).
FEW_TEXTS = 500_000

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long"


# ---- blocks ----


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over every ``width`` neighbouring values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(values) - width + 1], out[width - have :]) if have < width else out


def symbols(data: np.ndarray, off: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """What is compared: bytes, or hashes of words; and each text's first one (n + 1 numbers)."""
    if not words:
        return data, off
    hashes, _, _, first = scan.words(data, off, scan.SOLID)
    return hashes, first


def blocks(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(text, first window, number of windows, name, hash of the whole string, whether the name repeats nearby)."""
    prefix, n, width = scan.Prefix(data), len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    at = np.arange(n - gram + 1)
    grams = prefix.hashes(at, at + gram)
    least = _sliding(grams, width, np.minimum)
    valid = np.zeros(len(least) + 1, np.int64)
    for a, b in zip(off.tolist(), off[1:].tolist()):
        if b - a >= length:
            valid[a] += 1
            valid[b - length + 1] -= 1
    valid = np.cumsum(valid[:-1]) > 0
    starts = off[:-1][np.diff(off) >= length]
    new = np.empty(len(least), bool)
    new[0] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[1:] |= ~valid[:-1]
    new[starts] = True
    first = np.flatnonzero(new & valid)
    ends = np.append(new[1:] | ~valid[1:], True)
    size = np.flatnonzero(ends & valid) + 1 - first
    names = least[first]
    # A gram is the least of some window if it equals the largest of the least values of the windows that hold it.
    held = np.zeros(len(grams) + width - 1, np.uint64)
    held[width - 1 : width - 1 + len(least)] = np.where(valid, least, 0)
    minimal = np.flatnonzero(_sliding(held, width, np.maximum) == grams)
    order = minimal[np.lexsort((minimal, grams[minimal]))]
    twice = (grams[order[1:]] == grams[order[:-1]]) & (order[1:] - order[:-1] < int(size.max(initial=0)) + width)
    repeats = np.isin(names, grams[order[1:][twice]])
    whole = prefix.hashes(first, first + size - 1 + length)
    return np.searchsorted(off, first, "right") - 1, first, size, names, whole, repeats


# ---- suffix arrays ----


def _packed(data: np.ndarray) -> tuple[np.ndarray, int, int]:
    """As many values from each place on as fit one number, how many they are, and the bits of each."""
    bits = max(1, int(data.max()).bit_length())
    several, n = max(1, 64 // bits), len(data)
    wide = np.concatenate((data.astype(np.uint64), np.zeros(several, np.uint64)))
    key = np.zeros(n, np.uint64)
    for k in range(several):
        key = key << np.uint64(bits) | wide[k : k + n]
    return key, several, bits


def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the suffixes, sorted by their first ``depth`` values or more; data has 0 as its least value."""
    n = len(data)
    bits = n.bit_length()
    key, h, _ = _packed(data)
    order = np.argsort(key)
    key = key[order]
    fresh = np.append(True, key[1:] != key[:-1])
    heads = np.flatnonzero(fresh)
    rank = np.zeros(n + 1, np.int32 if bits < 32 else np.int64)
    rank[n] = -1
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    unsorted = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    further = 2 if 3 * bits < 64 else 1  # ranks that fit one number besides a place's own
    while h < depth and len(unsorted):
        places = order[unsorted]
        key = rank[places].astype(np.int64)
        for k in range(1, further + 1):
            key = key << bits | rank[np.minimum(places + k * h, n)].astype(np.int64) + 1
        again = np.argsort(key)
        places, key = places[again], key[again]
        order[unsorted] = places
        fresh = np.append(True, key[1:] != key[:-1])
        heads = unsorted[fresh]
        counts = np.diff(np.append(np.flatnonzero(fresh), len(unsorted)))
        rank[places] = np.repeat(heads, counts)
        unsorted = unsorted[np.repeat(counts > 1, counts)]
        h *= further + 1
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Length that each suffix shares with the one before it in ``order``, by place; ``left``: values up to a text's end."""
    n = len(data)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    own = np.empty(n, bool)
    own[0] = True
    # Behind a place that shares nothing with its neighbour the rule says nothing.
    own[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (data[:-1] != data[np.maximum(before[:-1], 0)])
    ended = np.append(True, left[:-1] == 0)  # at the first byte of a string
    own |= ended | ended[np.maximum(before, 0)]
    heads = np.flatnonzero(own)
    shared = np.zeros(len(heads), np.int64)
    most = np.where(before[heads] >= 0, np.minimum(left[heads], left[np.maximum(before[heads], 0)]), 0)
    active = np.flatnonzero(most > 0)
    key, several, bits = _packed(data)
    while len(active):
        differ = key[heads[active] + shared[active]] ^ key[before[heads[active]] + shared[active]]
        run = np.full(len(active), several)
        odd = np.flatnonzero(differ)
        run[odd] = sum(differ[odd] >> np.uint64(bits * k) == 0 for k in range(several))
        shared[active] = np.minimum(shared[active] + run, most[active])
        active = active[(run == several) & (shared[active] < most[active])]
    size = np.diff(np.append(heads, n))
    value = np.repeat(shared, size) - (np.arange(n) - np.repeat(heads, size))
    return np.maximum(value, 0)


def window_classes(strings: list[np.ndarray], length: int) -> tuple[list[np.ndarray], int]:
    """For every string the class of each of its windows; equal windows, and no others, have the same class."""
    if any(s.dtype.itemsize > 1 for s in strings):
        ranks = np.unique(np.concatenate(strings), return_inverse=True)[1]
        strings = np.split(ranks, np.cumsum([len(s) for s in strings])[:-1])
    data = np.zeros(sum(map(len, strings)) + len(strings), np.uint32)
    left = np.zeros(len(data), np.int64)
    heads, at = [], 0
    for s in strings:
        data[at : at + len(s)] = s.astype(np.uint32) + 1
        left[at : at + len(s)] = np.arange(len(s), 0, -1)
        heads.append(at)
        at += len(s) + 1
    order = suffix_order(data, length)
    shared = common_prefixes(data, order, left)
    number = np.empty(len(data), np.int64)
    number[order] = np.cumsum(shared[order] < length)
    return [number[a : a + max(0, len(s) - length + 1)] for a, s in zip(heads, strings)], len(data) + 1


# ---- jobs ----


class _Steps:
    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, fresh_path(spark, "suffix-dedup"), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.option("compression", "zstd").parquet(f"{self.path}/{self.n}")
        return self.spark.read.parquet(f"{self.path}/{self.n}")


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, text): every row with the two hashes that name its text."""
    text = _text()
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), text.alias("text")
    )


_BLOCK = "doc_id long, t1 long, t2 long, at int, n int, name long, whole long, repeats boolean"


def _blocks(rows: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in scan.chunks(batch.column(3)):
                data, off = symbols(data, off, words)
                text, first, size, names, whole, repeats = blocks(data, off, length, gram)
                own = [batch.column(c).slice(lo, hi - lo).take(pa.array(text)) for c in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *own,
                        pa.array((first - off[text]).astype(np.int32)),
                        pa.array(size.astype(np.int32)),
                        pa.array(names.view(np.int64)),
                        pa.array(whole.view(np.int64)),
                        pa.array(repeats),
                    ],
                    _BLOCK.replace(",", "").split()[::2],
                )

    return rows.mapInArrow(run, _BLOCK)


def _strings(rows: DataFrame, wanted: DataFrame, length: int, words: bool) -> DataFrame:
    """(name, part, parts, t1, t2, at, copies, string) of the wanted blocks, read from their texts."""
    texts = wanted.select("t1", "t2", "doc_id").distinct()
    named = texts.select(F.col("t1").alias("w1"), F.col("t2").alias("w2"), F.col("doc_id").alias("id"))
    named = F.broadcast(named) if texts.count() <= FEW_TEXTS else named
    same = (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("id"))
    # One row of those that repeat a text and its doc_id speaks for all of them.
    found = rows.join(named, same, "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    lists = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("name", "part", "parts", "at", "n", "copies")).alias("blocks"))
    each = found.join(lists, ["t1", "t2"])
    schema = "name long, part int, parts int, t1 long, t2 long, at int, copies long, string binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2, lists = (batch.column(c).to_pylist() for c in ("t1", "t2", "blocks"))
            for lo, hi, data, off in scan.chunks(batch.column("text")):
                data, off = symbols(data, off, words)
                out = [
                    (b["name"], b["part"], b["parts"], t1[k], t2[k], b["at"], b["copies"], data[a : a + b["n"] - 1 + length].tobytes())
                    for k in range(lo, hi)
                    for b in lists[k]
                    for a in (int(off[k - lo]) + b["at"],)
                ]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, schema.replace(",", "").split()[::2])

    return each.select("t1", "t2", "blocks", "text").mapInArrow(run, schema)


_SHARD = "shard long, name long, parts int, t1 long, t2 long, at int, again binary, digests binary, classes binary"


def _shards(strings: DataFrame, length: int, shard_bytes: int, shards: int, words: bool) -> DataFrame:
    """One row per string: which windows are known to occur again, and digests of the windows where the name has several shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[dict] = []
        size = shard = 0
        task = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal shard
            shard += 1
            texts = [np.frombuffer(r["string"], np.uint64 if words else np.uint8) for r in held]
            classes, n = window_classes(texts, length)
            copies = np.repeat([r["copies"] for r in held], [len(c) for c in classes])
            total = np.bincount(np.concatenate(classes), copies, n)
            out = []
            for r, text, own in zip(held, texts, classes):
                digests = b""
                if r["parts"] > 1:
                    at = np.arange(len(own))
                    digests = scan.Prefix(text).hashes(at, at + length).tobytes()
                again = (total[own] >= 2).astype(np.uint8).tobytes()
                out.append((task << 32 | shard, r["name"], r["parts"], r["t1"], r["t2"], r["at"], again, digests, own.astype("<i8").tobytes() if digests else b""))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], _SHARD.replace(",", "").split()[::2])

        last = None
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["name"], r["part"])
                if held and key != last and size >= shard_bytes:
                    yield flush()
                    held, size = [], 0
                last = key
                held.append(r)
                size += len(r["string"])
        if held:
            yield flush()

    dealt = strings.repartition(shards, "name", "part").sortWithinPartitions("name", "part")
    return dealt.mapInArrow(run, _SHARD)


def _merged(shards: DataFrame) -> DataFrame:
    """(shard, name, found): sorted digests of a name's windows that other shards have too."""
    split = shards.where("parts > 1")
    cut = "shard long, name long, cut int, digests binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                digests = np.unique(np.frombuffer(r["digests"], np.uint64))
                cuts = (digests >> np.uint64(40)).astype(np.int64) * r["cuts"] >> 24
                edges = np.searchsorted(cuts, np.arange(r["cuts"] + 1)).tolist()
                out += [
                    (r["shard"], r["name"], c, digests[a:b].tobytes()) for c, (a, b) in enumerate(zip(edges, edges[1:])) if b > a
                ]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.int32(), pa.binary()])] if out else None
            if columns:
                yield pa.RecordBatch.from_arrays(columns, cut.replace(",", "").split()[::2])

    def look_up(table: pa.Table) -> pa.Table:
        shards_, parts = table.column("shard").to_numpy(), [np.frombuffer(d, np.uint64) for d in table.column("digests").to_pylist()]
        names, back = np.unique(shards_, return_inverse=True)
        own = [np.unique(np.concatenate([p for p, b in zip(parts, back) if b == k])) for k in range(len(names))]
        everything = np.sort(np.concatenate(own))
        found = []
        for digests in own:
            several = np.searchsorted(everything, digests, "right") - np.searchsorted(everything, digests, "left") > 1
            found.append(digests[several].tobytes())
        return pa.table({"shard": names, "name": [table.column("name")[0].as_py()] * len(names), "found": pa.array(found, pa.binary())})

    # A string's digests are some hundred; a cut gets those of about eight shards' worth of strings.
    sent = split.select("shard", "name", F.greatest(F.lit(1), F.ceil(F.col("parts") / 8)).cast("int").alias("cuts"), "digests")
    got = sent.mapInArrow(send, cut).groupBy("name", "cut").applyInArrow(look_up, "shard long, name long, found binary")
    return got.where(F.octet_length("found") > 0)


def _window_spans(again: np.ndarray, at: int, length: int) -> list[tuple[int, int]]:
    """Byte runs covered by the windows that occur again."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], again, [0]))))
    return [(at + a, at + b - 1 + length) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def _spans(shards: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """(t1, t2, from, to) of the covered bytes; what other shards have counts for a string's whole class."""
    lists = found.groupBy("shard", "name").agg(F.collect_list("found").alias("found"))
    rows = shards.join(lists, ["shard", "name"], "left").select("t1", "t2", "at", "again", "digests", "found")
    schema = "t1 long, t2 long, from int, to int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                again = np.frombuffer(r["again"], np.uint8).astype(np.int8)
                if r["found"]:
                    others = np.sort(np.concatenate([np.frombuffer(f, np.uint64) for f in r["found"]]))
                    own = np.frombuffer(r["digests"], np.uint64)
                    again = again | (others[np.minimum(np.searchsorted(others, own), len(others) - 1)] == own)
                out += [(r["t1"], r["t2"], a, b) for a, b in _window_spans(again.astype(np.int8), r["at"], length)]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], schema.replace(",", "").split()[::2])

    return rows.mapInArrow(run, schema)


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, split: int = SPLIT, words: bool = False
) -> DataFrame:
    """(t1, t2, spans): runs of bytes, or of words, of every text that has any; they may overlap."""
    if not 0 < gram < length:
        raise ValueError("the gram must be shorter than the string")
    spark = docs.sparkSession
    save, rows, width = _Steps(spark), _rows(docs), 8 if words else 1
    found = save(_blocks(rows, length, gram, words))
    several = found.groupBy("name").agg(F.count(F.lit(1)).alias("c"), F.max("repeats").alias("r")).where("c > 1 OR r").select("name")
    candidates = save(found.join(several, "name", "left_semi"))
    variants = save(
        candidates.groupBy("name", "whole").agg(
            F.count(F.lit(1)).alias("copies"), F.max("repeats").alias("repeats"), F.min(F.struct("t1", "t2", "doc_id", "at", "n")).alias("one")
        )
    )
    settled = candidates.join(variants.where("copies > 1").select("name", "whole"), ["name", "whole"], "left_semi")
    whole_spans = settled.select("t1", "t2", F.col("at").alias("from"), (F.col("at") + F.col("n") - 1 + length).alias("to")).distinct()
    size = F.sum((F.col("one.n") + length) * width).alias("bytes")
    names = variants.groupBy("name").agg(F.count(F.lit(1)).alias("strings"), F.max("repeats").alias("any_repeats"), size)
    parts = F.greatest(F.ceil(F.col("strings") / split), F.least(F.col("strings"), F.ceil(F.col("bytes") / (2 * shard_bytes))))
    names = names.where("strings > 1 OR any_repeats").withColumn("parts", parts.cast("int"))
    part = F.pmod(F.xxhash64("whole"), F.col("parts")).cast("int")
    mixed = variants.join(names, "name").select("name", part.alias("part"), "parts", "copies", "one.*")
    mixed = save(mixed)
    # Sorting suffixes is dear beside their bytes, so there are as many tasks as shards, whatever the bytes.
    size = mixed.agg(F.sum((F.col("n") - 1 + length) * width).alias("size")).first()["size"] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // (TASK_SHARDS * shard_bytes)))
    shards = save(_shards(_strings(rows, mixed, length, words), length, shard_bytes, tasks, words))
    spans = whole_spans.unionByName(_spans(shards, _merged(shards), length))
    return spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("from", "to")).alias("spans"))


def united(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans."""
    out: list[list[int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def _marked(docs: DataFrame, spans: DataFrame) -> DataFrame:
    return _rows(docs).join(spans, ["t1", "t2"], "left").drop("t1", "t2")


def _kept_parts(data: np.ndarray, off: np.ndarray, lists: list, first: int) -> Iterator[tuple[int, list[tuple[int, int]], bytes]]:
    """(bytes, removed runs, remaining bytes) of every text of a chunk."""
    cuts = off.tolist()
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        text = data[a:b].tobytes()
        gone = united(lists[first + k] or [], b - a)
        if gone:
            inner = [0, *[x for run in gone for x in run], b - a]
            yield b - a, gone, b"".join(text[x:y] for x, y in zip(inner[::2], inner[1::2]))
        else:
            yield b - a, gone, text


def remove_repeats(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, kept): the remaining bytes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            for lo, hi, data, off in scan.chunks(batch.column(1)):
                kept = [rest for _, _, rest in _kept_parts(data, off, lists, lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(kept, pa.binary())], ["doc_id", "kept"])

    return _marked(docs, repeated_spans(docs, **settings)).mapInArrow(run, "doc_id long, kept binary")


def removal(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE, passage_gram: int = PASSAGE_GRAM, **settings
) -> DataFrame:
    """Sizes, removed bytes and runs, the digest of the remaining bytes, and the words in repeated passages, of every row."""
    spans = repeated_spans(docs, length, gram, **settings)
    passages = repeated_spans(docs, passage, passage_gram, words=True, **settings).withColumnRenamed("spans", "passages")
    marked = _marked(docs, spans.join(passages, ["t1", "t2"], "full"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, passages = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for lo, hi, data, off in scan.chunks(batch.column(1)):
                got = [
                    (n, sum(b - a for a, b in gone), len(gone), hashlib.sha256(rest).hexdigest(), sum(b - a for a, b in united(told or [], n)))
                    for (n, gone, rest), told in zip(_kept_parts(data, off, lists, lo), passages[lo:hi])
                ]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*got), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], RESULT.replace(",", "").split()[::2])

    return marked.mapInArrow(run, RESULT)
