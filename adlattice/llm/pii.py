"""Sanitisation of personal data by patterns and by how much a term discloses.

Patterns find the protected entities: e-mail addresses, IP addresses, payment cards and phone numbers. A term that stands
near an entity and nearly nowhere else gives the entity away, even where the entity itself is removed. Over all documents
``disclosures`` estimates

    P(entity | term) = documents with the term near the entity / documents with the term
    bits             = log2(P(entity | term) / P(entity))

and names terms that reach ``MIN_GIVEN`` and whose bits are at least ``MIN_SHARE`` of -log2 P(entity), the most that any
term can give, so that an entity of a third of the documents is judged like one of a few. An entity of all documents has no
information, and no term reveals it. Terms near an entity in fewer than ``MIN_TEXTS`` different texts say nothing; copies
of a text count as one there. A call with ``min_bits`` asks for so many bits instead of the share.

``find`` adds the occurrences of such terms, outside the pattern spans, as spans of kind ``term``; ``sanitize`` replaces
pattern spans by the name of their kind and generalises terms to ``[TERM]``.

Terms reach the tasks in groups of at most ``TERMS_AT_ONCE`` hashes (8 bytes each); more terms take more groups, each of
which is one more map over the rows in the same job.

Defined results: a null text is an empty one without spans (and stays null in ``sanitize``); equal texts get equal spans;
``find`` ignores other columns and ``sanitize`` keeps them; a table without rows gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.llm import scan
from adlattice.session import fresh_path

#: The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Runs of digits with single dots between; four of them in a row, from the left, are a match of [0-9]+(\.[0-9]+){3}.
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

NEAR = 8
MIN_TEXTS = 3
MIN_GIVEN = 0.5
MIN_SHARE = 0.5
TERMS_AT_ONCE = 1_000_000
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # A match starts where the run of local characters before an @ does, so only those starts are tried.
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _octet(part: str) -> bool:
    """Whether digits of any number are at most 255."""
    value = part.lstrip("0")
    return len(value) < 3 or (len(value) == 3 and value <= "255")


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            own = parts[k : k + 4]
            size = sum(map(len, own)) + 3
            if all(map(_octet, own)):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[Span]:
    """Pattern spans in code points, by kind as listed and then by start."""
    out: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", a, b) for a, b in _ips(text)] if "." in text else []
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(text: str, span: Span) -> str:
    """One name for all spellings of an entity."""
    kind, a, b = span
    return f"{kind}:{text[a:b].lower() if kind == 'email' else text[a:b] if kind == 'ip' else re.sub('[^0-9]', '', text[a:b])}"


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


_HINT = np.zeros(256, bool)
_HINT[[64, *range(48, 58)]] = True


class Chunk:
    """A chunk of texts with the pattern spans of those that have any."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        hints = np.searchsorted(np.flatnonzero(_HINT[data]), off)
        self.texts: dict[int, str] = {}
        self.spans: dict[int, list[Span]] = {}
        for k in np.flatnonzero(np.diff(hints)).tolist():
            text = self.text(k)
            if spans := base_spans(text):
                self.texts[k], self.spans[k] = text, spans

    def text(self, k: int) -> str:
        return self.data[self.off[k] : self.off[k + 1]].tobytes().decode()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return scan.words(self.data, self.off, scan.ALNUM)

    def places(self, k: int, bytes_at: np.ndarray) -> np.ndarray:
        """Code points before the given bytes of text k."""
        lead = (self.data[self.off[k] : self.off[k + 1]] & 0xC0) != 0x80
        return np.concatenate(([0], np.cumsum(lead)))[bytes_at - self.off[k]]


def _clear(starts: np.ndarray, ends: np.ndarray, spans: list[Span]) -> np.ndarray:
    """Words that touch no span."""
    if not spans:
        return np.ones(len(starts), bool)
    by_start = sorted((a, b) for _, a, b in spans)
    begins, reach = np.array([a for a, _ in by_start]), np.maximum.accumulate([b for _, b in by_start])
    before = np.searchsorted(begins, ends)  # spans that begin before the word ends
    return (before == 0) | (reach[np.maximum(before - 1, 0)] <= starts)


def _near(docs: DataFrame, near: int) -> DataFrame:
    """(entity, term, text): hashes of the entities of a text and the terms near them; term is null once per entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in scan.chunks(batch.column(0)):
                chunk = Chunk(data, off)
                if not chunk.spans:
                    continue
                hashes, starts, ends, first = chunk.words()
                rows: list[tuple[int, int | None, int]] = []
                for k, spans in chunk.spans.items():
                    words = slice(first[k], first[k + 1])
                    from_, to = chunk.places(k, starts[words]), chunk.places(k, ends[words])
                    free = np.flatnonzero(_clear(from_, to, spans))
                    own = hashes[words].view(np.int64)[free]
                    text = _digest(chunk.texts[k])
                    seen: dict[int, set[int]] = {}
                    places = np.searchsorted(from_[free], [a for _, a, _ in spans]).tolist()
                    for span, at in zip(spans, places):
                        seen.setdefault(_digest(entity(chunk.texts[k], span)), set()).update(own[max(0, at - near) : at + near].tolist())
                    for name, terms in seen.items():
                        rows.append((name, None, text))
                        rows.extend((name, t, text) for t in terms)
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.RecordBatch.from_arrays(columns, ["entity", "term", "text"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "entity long, term long, text long")


def _digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _holders(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, n): partial numbers of rows with each term."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        table, total = scan.HashTable(terms.view(np.uint64)), np.zeros(len(terms), np.int64)
        for batch in batches:
            for _, _, data, off in scan.chunks(batch.column(0)):
                hashes, _, _, first = scan.words(data, off, scan.ALNUM)
                at = table.find(hashes)
                hit = np.flatnonzero(at >= 0)
                pair = np.unique(scan.owners(first)[hit] * len(terms) + at[hit])
                total += np.bincount(pair % len(terms), minlength=len(terms))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms[some]), pa.array(total[some])], ["term", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long")


def _groups(table: DataFrame, at_once: int) -> Iterator[np.ndarray]:
    """The distinct terms of a table in groups whose size is known to be small."""
    terms = table.select("term").distinct()
    groups = max(1, -(-terms.count() // (at_once // 2)))  # half, as groups by hash differ in size
    for g in range(groups):
        got = terms.where(F.pmod(F.xxhash64("term"), F.lit(groups)) == g).toArrow()
        if got.num_rows:
            yield np.sort(got.column(0).to_numpy())


def disclosures(
    docs: DataFrame,
    near: int = NEAR,
    min_texts: int = MIN_TEXTS,
    min_given: float = MIN_GIVEN,
    min_share: float = MIN_SHARE,
    at_once: int = TERMS_AT_ONCE,
    min_bits: float | None = None,
) -> DataFrame:
    """(term, entity, given, bits) of the terms that reveal an entity; terms and entities are 64-bit hashes."""
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "disclosures")
    _near(docs, near).groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("texts")
    ).where(F.col("term").isNull() | (F.col("texts") >= min_texts)).write.parquet(f"{path}/near")
    near_counts = spark.read.parquet(f"{path}/near")
    pairs, alone = near_counts.where("term IS NOT NULL"), near_counts.where("term IS NULL")
    held = None
    for terms in _groups(pairs, at_once):
        part = _holders(docs, terms)
        held = part if held is None else held.unionByName(part)
    if held is None:
        return spark.createDataFrame([], "term long, entity long, given double, bits double")
    holders = held.groupBy("term").agg(F.sum("n").alias("holders"))
    total = docs.select(F.count(F.lit(1)).alias("rows"))
    given = F.col("n") / F.col("holders")
    least = min_share * F.col("most") if min_bits is None else F.lit(min_bits)
    found = (
        pairs.join(holders, "term")
        .join(alone.select("entity", F.col("n").alias("entity_rows")), "entity")
        .withColumn("given", given)
        .withColumn("most", F.log2(total.scalar() / F.col("entity_rows")))
        .withColumn("bits", F.log2(given * total.scalar() / F.col("entity_rows")))
        .where((F.col("given") >= min_given) & (F.col("bits") >= least) & (F.col("most") > 0))
        .select("term", "entity", "given", "bits")
    )
    found.write.parquet(f"{path}/found")
    return spark.read.parquet(f"{path}/found")


def _term_places(chunk: Chunk, table: scan.HashTable, found: list[list[int]]) -> list[list[int]]:
    """``found`` (a list for each text) with the spans of the table's terms, as pairs of code points."""
    hashes, starts, ends, first = chunk.words()
    hit = np.flatnonzero(table.find(hashes) >= 0)
    cuts = np.searchsorted(hit, first)
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        own = hit[cuts[k] : cuts[k + 1]]
        from_, to = chunk.places(k, starts[own]), chunk.places(k, ends[own])
        free = _clear(from_, to, chunk.spans.get(k, []))
        found[k] = found[k] + np.stack((from_[free], to[free]), axis=1).reshape(-1).tolist()
    return found


def _with_terms(rows: DataFrame, terms: np.ndarray) -> DataFrame:
    """Adds the spans of the terms to the last column of rows whose last but one is the text."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = scan.HashTable(shared.value.view(np.uint64))
        for batch in batches:
            found = batch.column(len(names) - 1).to_pylist()
            for lo, hi, data, off in scan.chunks(batch.column(len(names) - 2)):
                found[lo:hi] = _term_places(Chunk(data, off), table, found[lo:hi])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int32()))], names)

    return rows.mapInArrow(run, rows.schema)


def _marked(rows: DataFrame, disclosed: DataFrame | None, at_once: int):
    """``rows``, whose last column is text, with a further column of term spans, and the broadcast terms still to be looked
    up: all groups of terms but the last take a map of their own."""
    out = rows.withColumn("_terms" + "_" * sum(map(len, rows.columns)), F.array().cast("array<int>"))
    last = np.zeros(0, np.int64)
    for terms in _groups(disclosed, at_once) if disclosed is not None else ():
        if len(last):
            out = _with_terms(out, last)
        last = terms
    return out, rows.sparkSession.sparkContext.broadcast(last)


def _term_spans(flat: list[int]) -> list[Span]:
    return sorted(("term", a, b) for a, b in zip(flat[::2], flat[1::2]))


def find(docs: DataFrame, disclosed: DataFrame | None = None, at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """Counts of the pattern spans of every row, their digest, and all spans as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = scan.HashTable(last.value.view(np.uint64))
        for batch in batches:
            terms = batch.column(2).to_pylist()
            for lo, hi, data, off in scan.chunks(batch.column(1)):
                chunk = Chunk(data, off)
                terms[lo:hi] = _term_places(chunk, table, terms[lo:hi])
                spans = [chunk.spans.get(k, []) for k in range(hi - lo)]
                counts = [pa.array([sum(s[0] == kind for s in own) for own in spans], pa.int64()) for kind in KINDS]
                base = [spans_text(own) for own in spans]
                whole = [spans_text(own + _term_spans(flat)) for own, flat in zip(spans, terms[lo:hi])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        *counts,
                        pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                        pa.array(whole, pa.string()),
                    ],
                    RESULT.replace(",", "").split()[::2],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked, last = _marked(rows, disclosed, at_once)
    return marked.mapInArrow(run, RESULT)


def sanitize(docs: DataFrame, disclosed: DataFrame | None = None, at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """``docs`` with every span replaced by its mark; where spans overlap, one mark for all of them, of the first."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col("text").cast("string"))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = scan.HashTable(last.value.view(np.uint64))
        for batch in batches:
            column = batch.column(len(names) - 1)
            terms, changed = batch.column(len(names)).to_pylist(), {}
            for lo, hi, data, off in scan.chunks(column):
                chunk = Chunk(data, off)
                terms[lo:hi] = _term_places(chunk, table, terms[lo:hi])
                for k in range(hi - lo):
                    spans = chunk.spans.get(k, []) + _term_spans(terms[lo + k])
                    if spans:
                        changed[lo + k] = replaced(chunk.text(k), spans)
            if changed:
                mask = np.zeros(batch.num_rows, bool)
                mask[list(changed)] = True
                column = pc.replace_with_mask(column, pa.array(mask), pa.array(list(changed.values()), column.type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], column], names)

    marked, last = _marked(rows, disclosed, at_once)
    return marked.mapInArrow(run, rows.schema).select(*[F.col(f"`{c}`") for c in docs.columns])


def replaced(text: str, spans: list[Span]) -> str:
    parts, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            parts += [text[done:a], MARKS[kind]]
        done = max(done, b)
    return "".join([*parts, text[done:]])
