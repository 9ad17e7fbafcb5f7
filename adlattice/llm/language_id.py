"""Language identification by multinomial logistic regression on character n-grams.

Features: n-grams of ``ORDERS`` lower-cased characters, hashed to ``BUCKETS``, weighted (1 + ln tf) * idf and scaled to
length 1. Document frequencies come from all training rows. Weights are fitted on a bounded sample of their different
texts, at most about ``SAMPLE``, as many of each language and each once, by follow-the-regularised-leader with L1 and L2
penalties, one text at a time. A fifth of the sample is kept back, on which a temperature is fitted that calibrates the
probabilities.

Training rows have a language and a crc32 of the doc_id (as text) whose remainder by 4 isn't 2.

With more languages than ``SAMPLE`` some get no example, and those are never predicted.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text where nothing could be
learnt; rows with the same or no doc_id are judged one by one; equal texts get equal results; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlattice.llm import scan

ORDERS = (1, 2, 3)
BITS = 15
BUCKETS = 1 << BITS
SAMPLE = 4000
UNKNOWN = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of the first 65,536 code points, and which code points are letters."""
    import regex

    lower = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and len(small := chr(c).lower()) == 1:
            lower[c] = ord(small)
    letter = np.zeros(0x110000, bool)
    points = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "!" for c in range(0x110000))
    for m in regex.finditer(r"\p{L}+", points):
        letter[m.start() : m.end()] = True
    return lower, letter


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(buckets, counts, whether it has a letter) of every text of a chunk."""
    lower, letter = _tables()
    points, first = scan.code_points(data, off)
    has_letter = scan.sums(letter[points], first) > 0
    small = points < 1 << 16
    points[small] = lower[points[small]]
    grams, key = [], np.zeros(len(points), np.uint32)
    for k in range(max(ORDERS)):
        key = key[: len(points) - k] * np.uint32(0x01000193) + points[k:]
        if k + 1 in ORDERS:
            spread = (key + np.uint32(k * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(2654435761)
            spread ^= spread >> np.uint32(15)
            grams.append((k, (spread * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.uint16)))
    for d, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
        own = [g[a : max(a, b - k)] for k, g in grams]
        counts = np.bincount(np.concatenate(own), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        yield used, counts[used], bool(has_letter[d])


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf
    norm = np.sqrt((x * x).sum())
    return x / norm if norm > 0 else x


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return weighted(counts, self.idf[buckets]) @ self.weights[buckets] + self.bias

    def predict(self, buckets: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        p = _softmax(self.logits(buckets, counts) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    classes: int,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.01,
    l2: float = 0.1,
    epochs: int = 4,
    seed: int = 7,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (buckets, values, class): per-coordinate steps, elastic-net penalties on the weights."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def current(at: np.ndarray) -> np.ndarray:
        free = at[:, None] < BUCKETS  # the bias bears no L1
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1 * free, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)).tolist():
            buckets, values, label = rows[r]
            at, x = np.append(buckets, BUCKETS), np.append(values, 1.0)
            w = current(at)
            error = _softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            squares = n[at] + g * g
            z[at] += g - (np.sqrt(squares) - np.sqrt(n[at])) / alpha * w
            n[at] = squares
    w = current(np.arange(BUCKETS + 1))
    return w[:BUCKETS], w[BUCKETS]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-12)).mean())

    if len(labels) == 0:
        return 1.0
    lo, hi, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of the training rows; None if there is no language to learn."""
    spark = docs.sparkSession
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    rows = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    texts = rows.select("lang", F.xxhash64("text", F.lit(11)).alias("key")).distinct()
    sizes = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            for _, _, data, off in scan.chunks(batch.column(0)):
                for buckets, _, _ in features(data, off):
                    df[buckets] += 1
                    n += 1
        df[BUCKETS] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(df)], ["bucket", "n"])

    counted = rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(BUCKETS + 1)
    df[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1

    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample / len(sizes) / n)))])
    # The place of a text among all is drawn from its hash, so that copies go the same way; one of them is read.
    drawn = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    chosen = rows.where(drawn < share[F.col("lang")]).select("lang", "text").distinct()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in scan.chunks(batch.column(1)):
                got = list(features(data, off))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([b.astype("<u2").tobytes() for b, _, _ in got], pa.binary()),
                        pa.array([c.astype("<u4").tobytes() for _, c, _ in got], pa.binary()),
                    ],
                    ["lang", "buckets", "counts"],
                )

    table = chosen.mapInArrow(gather, "lang string, buckets binary, counts binary").toArrow().to_pylist()
    number = {lang: k for k, lang in enumerate(languages)}
    examples = []
    for row in table:
        buckets = np.frombuffer(row["buckets"], "<u2").astype(np.int64)
        values = weighted(np.frombuffer(row["counts"], "<u4").astype(float), idf[buckets])
        examples.append((buckets, values, number[row["lang"]]))
    examples.sort(key=lambda e: (e[2], len(e[0]), e[0].tobytes(), e[1].tobytes()))
    part = np.random.default_rng(3).random(len(examples)) < 0.2
    fitted = [e for e, p in zip(examples, part) if not p]
    weights, bias = fit_ftrl(fitted, len(languages))
    back = [e for e, p in zip(examples, part) if p]
    logits = np.array([e[1] @ weights[e[0]] + bias for e in back]).reshape(-1, len(languages))
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), bias, fit_temperature(logits, np.array([e[2] for e in back], int)))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for lo, hi, data, off in scan.chunks(batch.column(2)):
                got = [
                    model.predict(buckets, counts) if model and letter else (UNKNOWN, 0.0)
                    for buckets, counts, letter in features(data, off)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(lo, hi - lo) for c in (0, 1)],
                        pa.array([g[0] for g in got], pa.string()),
                        pa.array([g[1] for g in got], pa.float64()),
                    ],
                    RESULT.replace(",", "").split()[::2],
                )

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, RESULT)


def identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return predict(docs, train(docs, sample))
