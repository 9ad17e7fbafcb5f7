"""Toxicity scores of a convolutional text classifier.

A word's vector is the sum of hashed embeddings, of the whole word and of its first bytes (``PREFIXES``). Filters of
``WIDTHS`` words run over the text, a rectifier and the largest value of each filter over the whole text follow, and a
logistic layer gives the score. The first number of every embedding starts as the significance (z) of the log odds of
its bucket between the labels; the others start near 0, so that words never met add nothing.

All labelled training rows are learnt from. They are dealt into shards of about ``SHARD`` rows by their doc_id; in each round (``EPOCHS``)
tasks train the same network in numpy on a shard each, and the changes are averaged over the shards, those of an embedding over the shards
that met it. What reaches the driver, or leaves it in a round, are the embeddings that were met: at most the size of the network.

Thresholds are calibrated by language on a fifth of the rows, kept from the training: the language of a text is guessed from its own words
(word frequencies by its ``lang`` column), the threshold of best F1 among texts so guessed becomes score 0.5, and
a slope common to all languages gives the rest of the scale. Logits are counted in steps of 1 / ``STEPS`` for that.
A language with too few examples takes the threshold of all.

Training rows have a label and a crc32 of the doc_id (as text) whose remainder by 5 isn't 0. A document with several labels
is toxic if one of them is.

Defined results: a null text is an empty one; texts without words all get the score of a text without any signal; where
nothing could be learnt all scores are 0; rows with the same or no doc_id are scored one by one; equal texts get equal
scores; ``keep_clean`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import copy
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlattice.llm import scan
from adlattice.operators.joins import lookup_join
from adlattice.session import durable, fresh_path

BITS = 16
PREFIXES = (4, 6)
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
SHARD = 1 << 14
EPOCHS = 5
STEPS = 1024
#: Embeddings that are averaged together.
BLOCK = 1 << 12
THRESHOLD = 0.5
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def word_buckets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their beginnings (a row for each), and the n + 1 numbers of each text's first word."""
    starts, ends = scan.runs(scan.ALNUM[data], off)
    prefix = scan.Prefix(scan.LOWER[data])
    cuts = [ends, *[np.minimum(ends, starts + n) for n in PREFIXES]]
    shift = np.uint64(64 - BITS)
    return np.stack([(prefix.hashes(starts, c) >> shift).astype(np.int64) for c in cuts]), np.searchsorted(starts, off)


@dataclass
class Network:
    tables: list[np.ndarray]
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float

    @classmethod
    def fresh(cls, seen: np.ndarray, total: np.ndarray, seed: int = 5) -> Network:
        """From the texts with each bucket by (table, label, bucket), and all texts by label."""
        r = np.random.default_rng(seed)
        tables = []
        for k in range(1 + len(PREFIXES)):
            table = r.normal(0, 0.01, (1 << BITS, DIM)).astype(np.float32)
            table[:, 0] = 0.2 * _significance(seen[k], total)
            tables.append(table)
        filters = [r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        biases = [np.full(FILTERS, 0.1, np.float32) for _ in WIDTHS]
        out = (0.3 * np.sign(np.concatenate([f[0, 0] for f in filters]))).astype(np.float32)
        return cls(tables, filters, biases, out, 0.0)

    def state(self) -> dict[str, np.ndarray]:
        """All numbers but the last bias, by name."""
        named = {"table": self.tables, "filter": self.filters, "bias": self.biases, "out": [self.out]}
        return {f"{kind}:{k}": value for kind, values in named.items() for k, value in enumerate(values)}

    def _padded(self, buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of all texts, each followed by enough zeros for the widest filter, and the starts of the texts."""
        pad = max(WIDTHS)
        size = np.diff(first)
        x = np.zeros((buckets.shape[1] + pad * len(size), DIM), np.float32)
        at = np.arange(buckets.shape[1]) + pad * scan.owners(first)
        x[at] = sum(table[b] for table, b in zip(self.tables, buckets))
        return x, first[:-1] + pad * np.arange(len(size))

    def pooled(self, x: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest value of every filter in every text, and the values of each width."""
        values, tails = [], np.append(heads[1:], len(x))
        for w, f, b in zip(WIDTHS, self.filters, self.biases):
            v = x @ f[0]
            for j in range(1, w):
                v[: len(x) - j] += x[j:] @ f[j]
            v += b
            np.maximum(v, 0, out=v)
            for j in range(1, w):  # these windows reach into the next text
                v[tails - j] = 0
            values.append(v)
        return np.concatenate([np.maximum.reduceat(v, heads, axis=0) for v in values], axis=1), values

    def logits(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        x, heads = self._padded(buckets, first)
        return self.pooled(x, heads)[0].astype(np.float64) @ self.out + self.out_bias


def _significance(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """z of the log odds of every bucket between label 1 and 0, between -4 and 4; 0 for buckets never met."""
    odds = np.log((seen + 0.5) / (total[:, None] - seen + 0.5))
    z = (odds[1] - odds[0]) / np.sqrt(1 / (seen[0] + 0.5) + 1 / (seen[1] + 0.5))
    return np.where(seen.sum(axis=0) > 0, np.clip(z, -4, 4), 0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class _Steps:
    """Adagrad steps; rows of a table are updated alone."""

    def __init__(self, net: Network, rate: float = 0.03):
        self.rate, self.sums = rate, {name: np.full(value.shape, 1e-3, np.float32) for name, value in net.state().items()}

    def __call__(self, name: str, value: np.ndarray, grad: np.ndarray, rows=slice(None)) -> None:
        total = self.sums[name]
        total[rows] += grad * grad
        value[rows] -= self.rate * grad / np.sqrt(total[rows])


def joined(examples: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, first words and labels of several texts."""
    first = np.concatenate(([0], np.cumsum([e[0].shape[1] for e in examples])))
    return np.concatenate([e[0] for e in examples], axis=1).astype(np.int64), first, np.array([e[1] for e in examples])


def train_round(net: Network, step: _Steps, examples: list[tuple[np.ndarray, int]], seed: int, batch: int = 32) -> None:
    """Train once on all (buckets, label); gradients reach only the words that a filter picked."""
    shuffled = np.random.default_rng(seed).permutation(len(examples))
    for lo in range(0, len(shuffled), batch):
        buckets, first, label = joined([examples[i] for i in shuffled[lo : lo + batch]])
        x, heads = net._padded(buckets, first)
        pooled, values = net.pooled(x, heads)
        error = ((_sigmoid(pooled @ net.out + net.out_bias) - label) / len(label)).astype(np.float32)
        back = error[:, None] * net.out[None, :] * (pooled > 0)
        tails = np.append(heads[1:], len(x))
        touched, grads = [], []
        for k, (w, v) in enumerate(zip(WIDTHS, values)):
            picked = np.stack([a + v[a:b].argmax(axis=0) for a, b in zip(heads, tails)])
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            df = np.zeros_like(net.filters[k])
            for j in range(w):
                place = np.minimum(picked + j, len(x) - 1)
                df[j] = np.einsum("df,dfe->ef", g, x[place])
                touched.append(place.reshape(-1))
                grads.append((g[:, :, None] * net.filters[k][j].T[None, :, :]).reshape(-1, DIM))
            step(f"filter:{k}", net.filters[k], df)
            step(f"bias:{k}", net.biases[k], g.sum(axis=0))
        step("out:0", net.out, pooled.T @ error + 1e-4 * net.out)
        net.out_bias -= step.rate * float(error.sum())
        word = np.full(len(x), -1)
        word[max(WIDTHS) * scan.owners(first) + np.arange(buckets.shape[1])] = np.arange(buckets.shape[1])
        at, grad = word[np.concatenate(touched)], np.concatenate(grads)
        grad, at = grad[at >= 0], at[at >= 0]
        for k, table in enumerate(net.tables):
            rows, back_to = np.unique(buckets[k][at], return_inverse=True)
            total = np.zeros((len(rows), DIM), np.float32)
            np.add.at(total, back_to, grad)
            step(f"table:{k}", table, total, rows)


@dataclass
class Guesser:
    """Languages by the words of a text."""

    languages: list[str]
    logs: np.ndarray

    @classmethod
    def fit(cls, words: dict[str, np.ndarray]) -> Guesser:
        """From the words of each bucket by language."""
        languages = sorted(words)
        counts = np.full((len(languages), 1 << BITS), 0.1)
        for at, lang in enumerate(languages):
            counts[at] += words[lang]
        logs = np.log(counts / counts.sum(axis=1, keepdims=True))
        return cls(languages, (logs - logs.mean(axis=0)).T.astype(np.float32).copy())

    def guess(self, whole: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Number of the language of every text; 0 for texts without words."""
        best = np.zeros(len(first) - 1, np.int64)
        full = np.flatnonzero(np.diff(first))
        if len(full) and self.languages:
            best[full] = np.add.reduceat(self.logs[whole], first[full], axis=0).argmax(axis=1)
        return best


def best_threshold(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The threshold of best F1, in the middle between the two values that it parts."""
    order = np.argsort(-logits, kind="stable")
    z, y, w = logits[order], labels[order], weights[order]
    hits, taken = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hits / (taken + (w * y).sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k] - 1)


@dataclass
class Model:
    network: Network
    guesser: Guesser
    thresholds: np.ndarray
    slope: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        buckets, first = word_buckets(data, off)
        z = self.network.logits(buckets, first)
        return _sigmoid(self.slope * (z - self.thresholds[self.guesser.guess(buckets[0], first)]))


def calibrate(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, language: np.ndarray, languages: int, least: int = 15):
    """Thresholds by language, and the slope of least log loss."""
    whole = best_threshold(logits, labels, weights)
    thresholds = np.full(max(1, languages), whole)
    for k in range(languages):
        own = language == k
        if min(weights[own & (labels == k)].sum() for k in (0, 1)) >= least:
            thresholds[k] = best_threshold(logits[own], labels[own], weights[own])
    z = logits - thresholds[language]

    def loss(slope: float) -> float:
        p = np.clip(_sigmoid(slope * z), 1e-6, 1 - 1e-6)
        return float(-(weights * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum())

    return thresholds, min(np.exp(np.linspace(np.log(0.05), np.log(20), 60)), key=loss)


def _examples(docs: DataFrame, labels: DataFrame, shard: int = SHARD) -> DataFrame:
    """(doc_id, toxic, lang, buckets, shard) of all labelled training rows; rows that repeat a doc_id count as one, the least.

    The texts move once, to their shards, where the examples are written, so that no round moves them again.
    """
    marks = durable(
        labels.where(F.col("toxic").cast("int").isin(0, 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("_toxic"))
        .where(~held_out())
        .groupBy("doc_id")
        .agg(F.max("_toxic").alias("_toxic"))
    )
    shards = max(1, -(-marks.count() // shard))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    marked = lookup_join(rows, marks, ["doc_id"], "inner", ["doc_id"])
    dealt = marked.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(shards))).repartition(shards, "shard")
    one = dealt.groupBy("shard", "doc_id", "_toxic").agg(F.min(F.struct("text", "lang")).alias("row"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in scan.chunks(batch.column(3)):
                buckets, first = word_buckets(data, off)
                own = [np.ascontiguousarray(buckets[:, a:b]).astype("<u2").tobytes() for a, b in zip(first, first[1:])]
                doc, toxic, lang, number = (batch.column(c).slice(lo, hi - lo) for c in (0, 1, 2, 4))
                yield pa.RecordBatch.from_arrays([doc, toxic, lang, pa.array(own, pa.binary()), number], ["doc_id", "toxic", "lang", "buckets", "shard"])

    spark, name = docs.sparkSession, f"toxicity_{uuid.uuid4().hex}"
    found = one.select("doc_id", "_toxic", "row.lang", "row.text", "shard")
    found = found.mapInArrow(gather, "doc_id long, toxic int, lang string, buckets binary, shard long")
    writer = found.write.bucketBy(shards, "shard").option("path", fresh_path(spark, "toxicity")).option("compression", "zstd")
    writer.saveAsTable(name)
    return spark.table(name)


def _unpacked(table: pa.Table | pa.RecordBatch) -> list[tuple[np.ndarray, int]]:
    both = zip(table.column("buckets").to_pylist(), table.column("toxic").to_pylist())
    return [(np.frombuffer(b, "<u2").reshape(1 + len(PREFIXES), -1), label) for b, label in both]


def _counted(examples: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Texts with each bucket by (table, label, bucket), and words of each bucket by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, words = np.zeros((1 + len(PREFIXES), 2, 1 << BITS), np.int64), {}
        for batch in batches:
            for (buckets, label), lang in zip(_unpacked(batch), batch.column("lang").to_pylist()):
                for k, own in enumerate(buckets):
                    seen[k, label, np.unique(own)] += 1
                if lang is not None:
                    words.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    words[lang] += np.bincount(buckets[0], minlength=1 << BITS)
        out = [(2 * k + label, None, seen[k, label]) for k in range(len(seen)) for label in (0, 1)] + [(-1, lang, n) for lang, n in words.items()]
        columns = [pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.string()), pa.array([o[2].astype("<i8").tobytes() for o in out], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["at", "lang", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(n, "<i8") for n in table.column("n").to_pylist())
        return pa.table({"at": table.column("at")[:1], "lang": table.column("lang")[:1], "n": pa.array([total.tobytes()], pa.binary())})

    schema = "at long, lang string, n binary"
    got = examples.mapInArrow(run, schema).groupBy("at", "lang").applyInArrow(add, schema).toArrow()
    seen, words = np.zeros((1 + len(PREFIXES), 2, 1 << BITS), np.int64), {}
    for r in got.to_pylist():
        n = np.frombuffer(r["n"], "<i8")
        if r["at"] < 0:
            words[r["lang"]] = n
        else:
            seen[r["at"] // 2, r["at"] % 2] = n
    return seen, words


_CHANGES = "name string, block long, shard long, met binary, change binary, sums binary"


def _blocks(name: str, size: int) -> Iterator[tuple[int, slice]]:
    width = BLOCK if name.startswith("table") else size
    for lo in range(0, size, width):
        yield lo // width, slice(lo, lo + width)


def _applied(net: Network, step: _Steps, changes: pa.Table) -> None:
    """Add averaged changes: of each block, the rows that any shard met."""
    state = net.state()
    for r in changes.to_pylist():
        met, change, sums = (np.frombuffer(r[c], kind) for c, kind in (("met", "<u2"), ("change", "<f4"), ("sums", "<f4")))
        if r["name"] == "out_bias":
            net.out_bias += float(change[0])
            continue
        at = met + (r["block"] * BLOCK if r["name"].startswith("table") else 0)
        for whole, part in ((state[r["name"]], change), (step.sums[r["name"]], sums)):
            whole[at] += part.reshape(len(at), *whole.shape[1:])


def fit(examples: DataFrame, seen: np.ndarray, total: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Train on all examples: shards on their own, averaged after each round.

    What a round changed is sent once, of the rows that were met alone; tasks make the network anew from the counts and these changes.
    """
    sc = examples.sparkSession.sparkContext

    def average(table: pa.Table) -> pa.Table:
        """The mean change of the shards that met a row."""
        rows = sorted(table.select(["shard", "met", "change", "sums"]).to_pylist(), key=lambda r: r["shard"])
        met = [np.frombuffer(r["met"], "<u2") for r in rows]
        union = np.unique(np.concatenate(met))
        places = [np.searchsorted(union, m) for m in met]
        share = np.zeros((len(union), 1), np.int64)
        for at in places:
            share[at] += 1
        means = {}
        for c in ("change", "sums"):
            parts = [np.frombuffer(r[c], "<f4").astype(np.float64).reshape(len(m), -1) for r, m in zip(rows, met)]
            whole = np.zeros((len(union), parts[0].shape[1]))
            for at, part in zip(places, parts):
                whole[at] += part
            means[c] = pa.array([(whole / share).astype("<f4").tobytes()], pa.binary())
        first = {c: table.column(c)[:1] for c in ("name", "block", "shard")} | {"met": pa.array([union.astype("<u2").tobytes()], pa.binary())}
        return pa.table(first | means)

    def trainer(first, rounds: list):
        def run(table: pa.Table) -> pa.Table:
            start = Network.fresh(*first.value)
            sums = _Steps(start)
            for changes in rounds:
                _applied(start, sums, changes.value)
            own, steps = copy.deepcopy(start), copy.deepcopy(sums)
            train_round(own, steps, _unpacked(table.sort_by([("doc_id", "ascending"), ("buckets", "ascending")])), len(rounds) + 1)
            out = [("out_bias", 0, np.zeros(1), np.array([own.out_bias - start.out_bias]), np.zeros(1))]
            before = start.state()
            for name, value in own.state().items():
                change, more = value - before[name], steps.sums[name] - sums.sums[name]
                for block, at in _blocks(name, len(value)):
                    met = np.flatnonzero((more[at] != 0).any(axis=1)) if name.startswith("table") else np.arange(len(value))
                    if len(met):
                        out.append((name, block, met, change[at][met], more[at][met]))
            number = table.column("shard")[0].as_py()
            numbers = lambda k, kind: pa.array([o[k].astype(kind).tobytes() for o in out], pa.binary())
            columns = [pa.array([o[0] for o in out]), pa.array([o[1] for o in out]), pa.array([number] * len(out))]
            return pa.table([*columns, numbers(2, "<u2"), numbers(3, "<f4"), numbers(4, "<f4")], names=["name", "block", "shard", "met", "change", "sums"])

        return run

    net = Network.fresh(seen, total)
    step = _Steps(net)
    first, rounds = sc.broadcast((seen, total)), []
    for left in reversed(range(epochs)):
        changes = examples.groupBy("shard").applyInArrow(trainer(first, rounds), _CHANGES).groupBy("name", "block").applyInArrow(average, _CHANGES).drop("shard").toArrow()
        _applied(net, step, changes)
        if left:
            rounds = [*rounds, sc.broadcast(changes)]
    for sent in (first, *rounds):
        sent.destroy()
    return net


def train(docs: DataFrame, labels: DataFrame, shard: int = SHARD) -> Model | None:
    """A model of the labelled training rows of ``docs``; None unless both labels occur."""
    aside = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(5)) == 0
    examples = _examples(docs, labels, shard).withColumn("aside", aside)
    sizes = {(r["toxic"], r["aside"]): r["n"] for r in examples.groupBy("toxic", "aside").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len({toxic for toxic, _ in sizes}) < 2:
        return None
    if len(sizes) == 4:
        learnt, held = examples.where("NOT aside"), examples.where("aside")
        total = np.array([sizes[k, False] for k in (0, 1)])
    else:
        learnt = held = examples
        total = np.array([sum(n for (toxic, _), n in sizes.items() if toxic == k) for k in (0, 1)])
    seen, words = _counted(learnt)
    network, guesser = fit(learnt, seen, total), Guesser.fit(words)
    shared = docs.sparkSession.sparkContext.broadcast((network, guesser))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, guesser = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                buckets, first, label = joined(_unpacked(batch.slice(lo, 64)))
                at = np.clip(np.rint(network.logits(buckets, first) * STEPS), -(1 << 17), 1 << 17).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(guesser.guess(buckets[0], first)), pa.array(label), pa.array(at)], ["language", "toxic", "at"])

    judged = held.mapInArrow(judge, "language long, toxic long, at long").groupBy("language", "toxic", "at").agg(F.count(F.lit(1)).alias("n"))
    got = judged.orderBy("language", "toxic", "at").toArrow()
    language, label, at, n = (got.column(c).to_numpy() for c in ("language", "toxic", "at", "n"))
    thresholds, slope = calibrate(at / STEPS, label, n.astype(np.float64), language, len(guesser.languages))
    return Model(network, guesser, thresholds, float(slope))


def _scored(docs: DataFrame, model: Model | None, text: int, keep_text: bool) -> DataFrame:
    """``docs``, with the text or without, and a last column for its score; columns are named by number."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    out = [f for k, f in enumerate(plain.schema) if keep_text or k != text]
    names = [*[f.name for f in out], "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, data, off in scan.chunks(batch.column(text)):
                score = model.scores(data, off) if model else np.zeros(hi - lo)
                kept = [c.slice(lo, hi - lo) for k, c in enumerate(batch.columns) if keep_text or k != text]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score)], names)

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in out], "score double"])
    return plain.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from the text alone."""
    rows = docs.select(F.col("doc_id").cast("long"), held_out(), F.col("text").cast("string"))
    out = _scored(rows, model, 2, keep_text=False).toDF("doc_id", "held_out", "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    out = _scored(docs, model, docs.columns.index("text"), keep_text=True)
    return out.where(F.col("score") < THRESHOLD).drop("score").toDF(*docs.columns)


def scored(docs: DataFrame, labels: DataFrame, shard: int = SHARD) -> DataFrame:
    return score(docs, train(docs, labels, shard))
