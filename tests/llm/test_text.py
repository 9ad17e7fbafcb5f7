"""Decontamination, repeats, near copies, personal data and language-model scores: against brute force."""

import collections
import gc
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import SCHEMA, by_text, checked, edited, prose, row

from adlattice.llm import decontaminate, near_dup, pii, scan, suffix_dedup, suffix_tree
from adlattice.session import durable


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- decontamination ----


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


@pytest.fixture(scope="module")
def items(spark, docs):
    texts = [r["text"] for r in docs.collect() if r["text"]]
    long = sorted(texts, key=len)
    rows = [
        (0, " ".join(long[-3].split()[5:40])),
        (1, " ".join(long[-3].split()[20:60])),
        (2, "three, three"),
        (3, None),
        (4, "  ,"),
        (5, "nowhere at all in any text"),
        (10, "ONE"),
        (None, " ".join(long[-5].split()[:12])),
        (2, "three THREE"),
        (7, " ".join(["w"] * 30)),
    ]
    return spark.createDataFrame(rows, "item_id long, text string")


def brute_hits(text, items, window=10):
    words, hit, found = item_words(text), set(), set()
    for name, item in items:
        own = item_words(item)
        size = min(window, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words)):
            if size and tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add("" if name is None else str(name))
    return words, hit, found


@pytest.mark.parametrize("most_words", [decontaminate.AUTOMATON_WORDS, 20])
def test_contamination(docs, items, most_words):
    listed = [(r["item_id"], r["text"]) for r in items.collect()]

    def expected(text):
        words, hit, found = brute_hits(text, listed)
        return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)

    got = decontaminate.contamination(docs, items, most_words=most_words)
    checked(got, docs, ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"), expected)


def test_contamination_of_empty_tables(docs, empty, items):
    assert decontaminate.contamination(empty, items).count() == 0
    none = decontaminate.contamination(docs, items.where("false"))
    assert none.where("contaminated OR n_items > 0 OR n_hit > 0").count() == 0 and none.count() == docs.count()


@pytest.mark.parametrize("most_words", [decontaminate.AUTOMATON_WORDS, 20])
def test_remove_passages_of_all_automata(spark, docs, most_words):
    """Coverage and overlaps count over all items, whatever automata they are dealt to; one text under many ids."""
    words = [f"w{k}" for k in range(100)]
    passages = [" ".join(words[a : a + 14]) for a in (0, 15, 30, 34, 50)] + [" ".join(words[60:65] + words[80:85])]
    items = spark.createDataFrame([(k, p) for k, p in enumerate(passages)] + [(k, passages[0]) for k in range(50, 80)], "item_id long, text string")
    texts = [" ".join(words[:60]), " ".join(words), " ".join(words[25:100]), " ".join(words[60:65] + words[30:44] + words[80:85] + ["x"] * 40)]
    texts.append(" ".join(words[0:14] + ["y"] * 20 + words[50:64]))
    rows = spark.createDataFrame([row(k, t) for k, t in enumerate(texts)], SCHEMA)
    want = {}
    for k, t in enumerate(texts):
        own, hit, _ = brute_hits(t, [(r["item_id"], r["text"]) for r in items.collect()])
        if len(hit) <= len(own) / 2:
            want[k] = [w for i, w in enumerate(own) if i not in hit]
    out = decontaminate.remove_passages(rows, items, most_words=most_words)
    assert {r["doc_id"]: item_words(r["text"]) for r in out.collect()} == want and 0 < len(want) < len(texts)
    # The passages that removals bring together aren't hits, and other columns stay.
    assert out.columns == rows.columns


def test_copies_of_an_item_are_held_once(spark, docs, items, monkeypatch):
    more = items.unionByName(spark.createDataFrame([(100 + k, "three, three") for k in range(500)], items.schema))
    held = decontaminate.listed(more)
    assert held.where("text = 'three, three'").count() == 1 and decontaminate.item_groups(held) == 1
    whole = decontaminate.contamination(docs, more).collect()
    monkeypatch.setattr(decontaminate, "IDS_AT_ONCE", 50)
    split = decontaminate.listed(more)
    assert split.where("text = 'three, three' AND size(names) > 100").count() == 0
    parts = decontaminate.contamination(docs, more, most_words=300).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"])
    assert sorted(map(key, whole)) == sorted(map(key, parts)) and max(r["n_items"] for r in whole) >= 500


def test_remove_passages(docs, items):
    listed = [(r["item_id"], r["text"]) for r in items.collect()]
    out = decontaminate.remove_passages(docs, items)
    assert out.columns == docs.columns
    kept = {}
    for r in out.collect():
        kept.setdefault(r["doc_id"], []).append(r["text"])
    for r in docs.collect():
        words, hit, _ = brute_hits(r["text"], listed)
        if words and len(hit) > len(words) / 2:
            continue
        left = [w for k, w in enumerate(words) if k not in hit]
        match = [t for t in kept[r["doc_id"]] if item_words(t) == left and (hit or t == r["text"])]
        assert match, r


def test_automaton_takes_bounded_bytes():
    import tracemalloc

    r = np.random.default_rng(3)
    words = [r.integers(0, 1 << 60, 3000).astype(np.uint64)[r.integers(0, 3000, 500)] for _ in range(60)]
    tracemalloc.start()
    automaton = decontaminate.Automaton([(str(k), w) for k, w in enumerate(words)], 10)
    import pickle

    size = len(pickle.dumps(automaton))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    # Items of windows and the automaton, by word of the items.
    assert size < 100 * 30_000 and held < 500 * 30_000


def test_automaton_against_search():
    r = random.Random(2)
    for _ in range(200):
        window = r.randint(1, 5)
        names = [[r.randrange(3) for _ in range(r.randint(0, 9))] for _ in range(r.randint(1, 4))]
        listed = [(str(k), np.array(s, np.uint64)) for k, s in enumerate(names)]
        text = [r.randrange(4) for _ in range(20)]
        automaton = decontaminate.Automaton(listed, window)
        numbers = [int(np.searchsorted(automaton.vocabulary, w)) if w in automaton.vocabulary else -1 for w in text]
        hit, found = set(), set()
        for at, size, items in automaton.matches(numbers):
            hit.update(range(at - size + 1, at + 1))
            found |= items
        want_hit, want = set(), set()
        for k, own in enumerate(names):
            size = min(window, len(own))
            for i in range(len(text) - size + 1):
                if size and any(text[i : i + size] == own[j : j + size] for j in range(len(own) - size + 1)):
                    want_hit.update(range(i, i + size))
                    want.add(str(k))
        assert (hit, found) == (want_hit, want)


# ---- repeats ----


def brute_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        gone = gone[:-1]
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(
    "settings", [{}, {"length": 60, "gram": 25}, {"length": 60, "gram": 8, "split": 2, "shard_bytes": 300}, {"length": 5, "gram": 2, "split": 3}]
)
def test_removal(docs, settings):
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r["text"] for r in rows], brute_removal([r["text"] for r in rows], settings.get("length", 400))))
    got = suffix_dedup.removal(docs, **settings)
    checked(got, docs, ("n_bytes", "n_removed", "n_spans", "kept_sha256"), lambda t: want.get(t) or want[None])


def test_rows_that_repeat_send_their_strings_once(spark, monkeypatch):
    """Copies of a text without doc_id, or with the same, are one text to the suffix arrays."""
    texts = [prose(1, 300), prose(2, 60) + " " + prose(1, 300)[200:1500] + " " + prose(3, 60)]
    rows = [row(None, texts[0]) for _ in range(150)] + [row(7, texts[1]) for _ in range(150)]
    sent, shards = [], suffix_dedup._shards
    monkeypatch.setattr(suffix_dedup, "_shards", lambda strings, *more: sent.append(strings.count()) or shards(strings, *more))
    got = suffix_dedup.removal(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 300 and all(r["n_removed"] == r["n_bytes"] for r in got)
    assert sent[0] < 150


def brute_repeated_words(texts, passage):
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    seen = collections.Counter(tuple(w[i : i + passage]) for w in words for i in range(len(w) - passage + 1))
    out = []
    for w in words:
        at = {j for i in range(len(w) - passage + 1) if seen[tuple(w[i : i + passage])] > 1 for j in range(i, i + passage)}
        out.append(len(at))
    return out


def test_repeated_words(docs):
    texts = [r["text"] for r in docs.select("text").collect()]
    want = dict(zip(texts, brute_repeated_words(texts, 12)))
    assert any(want.values())
    got = suffix_dedup.removal(docs, passage=12, passage_gram=5, split=2, shard_bytes=300)
    checked(got, docs, ("n_repeated_words",), lambda t: (want[t],))


def test_passages_shorter_than_a_removed_string(spark):
    """A passage of over 50 words in two texts is told, though no 400 bytes of it can go."""
    passage = " ".join(random.Random(5).choices(["la", "de", "osci", "quene", "unas"], k=55))
    rows = [row(1, prose(1, 80) + " " + passage + " " + prose(2, 80)), row(2, prose(3, 60) + " " + passage.upper()), row(3, prose(4, 200)), row(4, None)]
    got = {r["doc_id"]: r for r in suffix_dedup.removal(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(passage) < 400 and all(r["n_removed"] == 0 for r in got.values())
    assert {k: r["n_repeated_words"] for k, r in got.items()} == {1: 55, 2: 55, 3: 0, 4: 0}


def test_remove_repeats(docs, empty):
    digests = {r["kept_sha256"] for r in suffix_dedup.removal(docs).collect()}
    kept = suffix_dedup.remove_repeats(docs).collect()
    assert {hashlib.sha256(bytes(r["kept"])).hexdigest() for r in kept} == digests and len(kept) == docs.count()
    assert suffix_dedup.removal(empty).count() == 0


def test_window_classes():
    r = random.Random(3)
    for _ in range(150):
        length = r.choice([1, 3, 9])
        strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 25))) for _ in range(r.randint(1, 6))]
        classes, _ = suffix_dedup.window_classes([np.frombuffer(s, np.uint8) for s in strings], length)
        names = {}
        for s, own in zip(strings, classes):
            assert len(own) == max(0, len(s) - length + 1)
            for i, c in enumerate(own.tolist()):
                assert names.setdefault(s[i : i + length], c) == c
        assert len(set(names.values())) == len(names)


def test_window_classes_behind_nothing_shared():
    # A suffix whose neighbour is the successor of the neighbour before it, which shares nothing.
    run = b"c" + b"b" * 30 + b"xyz" * 9
    for strings, length in [([b"baa"], 1), ([b"b" + b"a" * 20], 6), ([b"a" + run, b"b" + run, b"c" + run], 12)]:
        classes, _ = suffix_dedup.window_classes([np.frombuffer(s, np.uint8) for s in strings], length)
        names = {}
        for s, own in zip(strings, classes):
            for i, c in enumerate(own.tolist()):
                assert names.setdefault(s[i : i + length], c) == c
        assert len(set(names.values())) == len(names)


# ---- near copies ----


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute_components(rows, size):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return [(len(s), least.get(find(k)) if s else rows[k][0]) for k, s in enumerate(sets)]


def near_rows():
    base = [prose(800 + k, 80 + 20 * k) for k in range(4)]
    rows = [row(1000 + k, edited(base[k % 4], k, 1 + k % 9)) for k in range(120)]
    chain, text = [], prose(900, 150)
    for k in range(25):
        text = edited(text, 50 + k, 2)
        chain.append(row(2000 - k, text))
    return rows + chain


@pytest.mark.parametrize("settings", [{}, {"shingle": 5}, {"rounds": 0}])
def test_components(spark, docs, settings):
    every = docs.unionByName(spark.createDataFrame(near_rows(), SCHEMA))
    rows = [(r["doc_id"], r["text"]) for r in every.collect()]
    want = collections.Counter()
    for (doc_id, _), (n, component) in zip(rows, brute_components(rows, settings.get("shingle", 4))):
        want[doc_id, n, component, doc_id == component] += 1
    got = near_dup.components(every, **settings).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want


def test_small_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    every = spark.createDataFrame(near_rows(), SCHEMA)
    rows = [(r["doc_id"], r["text"]) for r in every.collect()]
    want = {doc_id: c for (doc_id, _), (_, c) in zip(rows, brute_components(rows, 4))}
    assert {r["doc_id"]: r["component_id"] for r in near_dup.components(every, rounds=1).collect()} == want


@pytest.mark.parametrize("rounds", [0, 2])
def test_repeated_rows(spark, rounds):
    rows = [(r[0], r[1]) for r in near_rows()]
    rows += rows[::5] * 2 + [(None, t) for _, t in rows[1::7]] * 3
    every = spark.createDataFrame([row(i, t) for i, t in rows], SCHEMA).repartition(3)
    want = collections.Counter((i, n, c, i == c) for (i, _), (n, c) in zip(rows, brute_components(rows, 4)))
    got = near_dup.components(every, rounds=rounds).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == want


def test_keep_one(docs, empty):
    out = near_dup.keep_one(docs)
    kept = near_dup.components(docs).where("kept")
    assert out.columns == docs.columns and out.count() == kept.count()
    assert near_dup.components(empty).count() == 0 and near_dup.keep_one(empty).count() == 0


# ---- personal data ----


def brute_base(text):
    text, out = text or "", []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ips = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
    out += [("ip", *m.span()) for m in ips if max(map(int, m.group().split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c in "0123456789"]
        total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans():
    r = random.Random(6)
    parts = ["a@b.c", "@", ".", "x", "1", "255.1.2.3", "300.1.1.1", "4111 1111-1111 1111", " ", "+1 (368) 555-0098", "é", "-", "+", "a.b@c", "..", "@@", "9" * 20]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert pii.base_spans(text) == brute_base(text), text


def test_spans_of_long_digits():
    """Numbers of any length, and runs of digits as long as a text, in linear time."""
    import time

    assert pii.base_spans("1" * 5000 + ".1.2.3") == []
    assert pii.base_spans("0" * 5000 + "1.1.2.3") == [("ip", 0, 5007)]
    assert pii.base_spans("1.2.3.4.5.6.7.8.9 300.1.1.1.1 256.0.0.1 1..2.3.4.5") == [
        ("ip", 0, 7), ("ip", 8, 15), ("ip", 43, 50)
    ]
    start = time.perf_counter()
    assert [s for s in pii.base_spans("7" * 400_000 + " 1.2.3.4") if s[0] == "ip"] == [("ip", 400_001, 400_008)]
    spans = [("ip", 10 * k, 10 * k + 12) for k in range(20_000)]
    starts = np.arange(0, 300_000, 3)
    free = pii._clear(starts, starts + 2, spans)
    assert time.perf_counter() - start < 5
    assert free.sum() == (starts >= 10 * 19_999 + 12).sum()
    r = random.Random(3)
    some = [(k, a, a + r.randrange(1, 9)) for k, a in enumerate(r.sample(range(200), 12))]
    words = np.arange(0, 200, 4)
    assert pii._clear(words, words + 3, some).tolist() == [all(w + 3 <= a or w >= b for _, a, b in some) for w in words.tolist()]


def test_find(docs, empty):
    disclosed = pii.disclosures(docs, min_bits=2.0)
    got, texts = by_text(pii.find(docs, disclosed), docs)
    terms = 0
    for key, rows in got.items():
        want = []
        for t in texts[key]:
            base = brute_base(t)
            counts = [sum(s[0] == k for s in base) for k in pii.KINDS]
            want.append((*counts, hashlib.sha256(pii.spans_text(base).encode()).hexdigest(), pii.spans_text(base)))
        have = []
        for r in rows:
            parts = [p for p in r["spans"].split(",") if p]
            terms += sum(p.startswith("term") for p in parts)
            base = ",".join(p for p in parts if not p.startswith("term"))
            assert parts == [p for p in parts if not p.startswith("term")] + [p for p in parts if p.startswith("term")]
            have.append((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], base))
        assert sorted(have) == sorted(want)
    assert terms >= 6
    assert pii.find(empty, pii.disclosures(empty)).count() == 0


def test_disclosures_against_counts(docs):
    near = 8
    rows = [r["text"] or "" for r in docs.collect()]
    holders, entities, pairs, texts = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for text in rows:
        spans = brute_base(text)
        words = [(m.group(), *m.span()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))]
        holders.update({w for w, _, _ in words})
        free = [w for w in words if all(w[2] <= a or w[1] >= b for _, a, b in spans)]
        seen = collections.defaultdict(set)
        for span in spans:
            at = sum(w[1] < span[1] for w in free)
            seen[pii.entity(text, span)] |= {w for w, _, _ in free[max(0, at - near) : at + near]}
        for name, terms in seen.items():
            entities[name] += 1
            for w in terms:
                pairs[name, w] += 1
                texts[name, w].add(text)
    want = collections.Counter()
    for (name, w), n in pairs.items():
        given, bits = n / holders[w], math.log2(n / holders[w] * len(rows) / entities[name])
        if len(texts[name, w]) >= 3 and given >= 0.5 and bits >= 2:
            want[round(given, 9), round(bits, 9)] += 1
    got = pii.disclosures(docs, min_bits=2.0, at_once=4).collect()
    assert want and collections.Counter((round(r["given"], 9), round(r["bits"], 9)) for r in got) == want


def test_disclosures_of_a_frequent_entity(spark):
    """A term that stands by an entity alone reveals it under the registered thresholds, however frequent the entity is."""
    r = random.Random(4)
    plain = lambda: " ".join(r.choice(["one", "two", "three", "four", "five", "six"]) for _ in range(12))
    hot = "hot.source@mail.example.com"
    rows = [f"{plain()} quorvex {hot} {plain()}" for _ in range(40)] + [f"same text quorvex {hot} twice {plain()}"] * 60
    rows += [f"{plain()} zimblat cold@mail.example.com {plain()}" for _ in range(4)] + [plain() + " " + plain() for _ in range(196)]
    docs = spark.createDataFrame([row(k, t) for k, t in enumerate(rows)], SCHEMA)
    texts = [x["text"] for x in pii.sanitize(docs, pii.disclosures(docs)).collect()]
    assert not any("quorvex" in t or "zimblat" in t for t in texts)
    assert sum("[TERM]" in t for t in texts) == 104 and all(re.search("one|two|three|four|five|six", t) for t in texts)


def test_sanitize(docs, empty):
    out = pii.sanitize(docs, pii.disclosures(docs, min_bits=2.0))
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = [r["text"] for r in out.collect()]
    assert all(not brute_base(t) for t in texts) and sum(t is None for t in texts) == 3
    assert sum("[EMAIL]" in (t or "") and "[TERM]" in t and "zorblax" not in t for t in texts) == 6
    assert pii.sanitize(empty).columns == docs.columns


# ---- language model ----


def symbols(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), "\0end"]


@pytest.mark.parametrize("head", [suffix_tree.HEAD, 5, 40])
def test_base_scores(docs, head):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(s for i, t in rows if not out(i) for s in symbols(t))
    n, v = sum(counts.values()), len(counts)
    got, texts = by_text(suffix_tree.model_scores(docs, head=head), docs)
    for key, some in got.items():
        want = []
        for t in texts[key]:
            own = symbols(t)
            base = sum(math.log10((counts[s] + 1) / (n + v + 1)) for s in own)
            want.append((out(key), len(own), sum(counts[s] > 0 for s in own), n, round(base, 5)))
        have = [(r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in some]
        assert sorted(have) == sorted(want)


def brute_tree(rows, depth, least, least_stored, divergence, mu):
    """Kept contexts with the probabilities of their stored symbols and the factor of the others."""
    counts = collections.Counter(s for t in rows for s in symbols(t))
    n, v = sum(counts.values()), len(counts)
    root = lambda s: (counts[s] + 1) / (n + v + 1)
    frequent = {s for s, c in counts.items() if c >= least}
    kept = {}

    def p(context, s):
        for k in range(min(depth, len(context)), 0, -1):
            own = kept.get(tuple(context[-k:]))
            if own:
                return own[0][s] if s in own[0] else own[1] * p(context[-(k - 1) :] if k > 1 else (), s)
        return root(s)

    level = [(s,) for s in frequent if s != "\0end"]
    for d in range(1, depth + 1):
        following = collections.defaultdict(collections.Counter)
        for t in rows:
            own = symbols(t)
            for i in range(d, len(own)):
                following[tuple(own[i - d : i])][own[i]] += 1
        fresh, longer = {}, []
        for context in level:
            seen, size = following[context], sum(following[context].values())
            some = {s: c for s, c in seen.items() if s in frequent and c >= least_stored}
            longer += [(*context, s) for s, c in some.items() if c >= least and s != "\0end"]
            below = {s: p(context[1:], s) for s in some}
            stored = {s: (c + mu * below[s]) / (size + mu) for s, c in some.items()}
            left, room = max(1 - sum(stored.values()), 1e-12), max(1 - sum(below.values()), 1e-12)
            gain = sum(x * math.log(x / below[s]) for s, x in stored.items()) + left * math.log(left / room)
            if some and gain >= divergence:
                fresh[context] = (stored, left / room)
        kept |= fresh
        level = longer
    return kept, p


@pytest.mark.parametrize(
    "settings",
    [{}, {"few": 0, "hot": 60}, {"hot": 0}, {"min_count": 3, "min_stored": 2, "hot": 300, "few": 50}],
)
def test_scores_of_the_tree(docs, settings):
    """The production values, and smaller counts; contexts known to tasks or counted by key, held by tasks or joined."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    least, stored = settings.get("min_count", suffix_tree.MIN_COUNT), settings.get("min_stored", suffix_tree.MIN_STORED)
    kept, p = brute_tree([t for i, t in rows if not out(i)], 3, least, stored, 0.02, 1.0)
    assert len({len(c) for c in kept}) == 3
    got, texts = by_text(suffix_tree.model_scores(docs, **settings), docs)
    for key, some in got.items():
        want = []
        for t in texts[key]:
            own = symbols(t)
            want.append(round(sum(math.log10(p(own[max(0, i - 3) : i], s)) for i, s in enumerate(own)), 5))
        assert sorted(round(r["score"], 5) for r in some) == pytest.approx(sorted(want), abs=2e-4)


@pytest.mark.parametrize("settings", [{"hot": 0}, {"few": 50, "hot": 300}])
def test_words_beyond_the_head_make_contexts(docs, settings):
    """With a head of 5 words the scores are those with a head of all words."""
    key = lambda frame: sorted((r["doc_id"] if r["doc_id"] is not None else -1, round(r["score"], 6), round(r["base_score"], 6)) for r in frame.collect())
    got, want = key(suffix_tree.model_scores(docs, head=5, **settings)), key(suffix_tree.model_scores(docs))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert [x for g in got for x in g[1:]] == pytest.approx([x for w in want for x in w[1:]], abs=2e-4)


def test_the_tree_grows_with_the_corpus(spark):
    """Four times the text has more than twice the contexts, and each is held by its own count."""
    sizes = []
    for times in (1, 4):
        rows = [(k, prose(10_000 + k, 120, 60)) for k in range(40 * times)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        counts = suffix_tree.count_symbols(df)
        tree = suffix_tree.grow(df, counts)
        sizes.append(tree.contexts.count())
        assert tree.contexts.agg({"size": "min"}).first()[0] >= suffix_tree.MIN_COUNT
    assert sizes[1] > 2 * sizes[0]


def test_numbers_of_pairs():
    r = np.random.default_rng(1)
    for contexts, words, expected in ((1, 1, 0), (5, 3, 10**9), (10**6, 10**6, 10**10), (1 << 20, 1 << 20, 1)):
        numbers = suffix_tree.Numbers(contexts, words, expected)
        c, w = r.integers(0, contexts, 500), r.integers(0, words, 500)
        got = numbers.parts(numbers.of(c, w))
        assert np.array_equal(got[0], c) and np.array_equal(got[1], w) and numbers.low <= 32


def test_scores_beat_the_root(docs, empty):
    total = suffix_tree.model_scores(docs).groupBy().sum("score", "base_score").first()
    assert total[0] > total[1]
    assert suffix_tree.model_scores(empty).count() == 0
    (only,) = suffix_tree.model_scores(docs.where("doc_id IS NULL AND text IS NULL")).collect()
    assert (only["n_tokens"], only["train_tokens"], only["n_known"]) == (1, 1, 1)


def test_counting_and_tables_hold_little_more_than_their_values():
    """Counting 2 million symbols took 8 times their bytes, placing 2 million keys 5 times those."""
    r = np.random.default_rng(4)
    values = r.integers(0, 1 << 20, 1 << 21).astype(np.uint64)
    want, times = np.unique(values, return_counts=True)
    parts = list(values.reshape(64, -1).copy())
    tracemalloc.start()
    got, n = suffix_tree.tallied(parts)
    counted = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all() and (n == times).all() and not parts and counted < 4 * values.nbytes
    tracemalloc.start()
    table = scan.HashTable(want)
    placed = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert placed < table.slots.nbytes + 3 * want.nbytes
    asked = np.concatenate([want[::7], want[:9] + np.uint64(1 << 40)])
    assert (table.find(asked) == [*range(0, len(want), 7), *[-1] * 9]).all()
    assert [len(x) for x in suffix_tree.tallied([np.zeros(0, np.uint64)])] == [0, 0]


def test_scoring_tables_hold_little_more_than_their_keys():
    """A worker held 16 bytes for each of so many contexts and symbols, besides their keys and logs, and a copy of a batch's training rows."""
    r = np.random.default_rng(5)
    keys = np.unique(r.integers(0, 1 << 64, (1 << 18) + 1, np.uint64).view(np.int64)).view(np.uint64)
    logs, able = np.zeros(len(keys)), np.ones(3, bool)
    hot = suffix_tree.Hot(keys[:3], logs[:3], -1.0, 0, able, keys, logs, keys, logs)
    tracemalloc.start()
    scorer = suffix_tree.Scorer(hot, 2)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 2 * 5 * len(keys)
    asked = np.concatenate([keys[::7], keys[:999] + np.uint64(1), np.array([0, 1 << 63, (1 << 64) - 1], np.uint64)])
    place = {k: at for at, k in enumerate(keys.tolist())}
    want = [place.get(k, -1) for k in asked.tolist()]
    assert scorer.pairs.find(asked).tolist() == want and scorer.contexts.find(asked).tolist() == want
    assert scan.SortedTable(keys[:0]).find(asked[:2]).tolist() == [-1, -1]
    near = np.array([-(1 << 63), -3, -2, 0, 1, 5, (1 << 63) - 1])
    assert scan.SortedTable(near).find(np.array([-(1 << 63), -4, -2, 1, 2, 5, (1 << 63) - 1, 7])).tolist() == [0, -1, 2, 4, -1, 5, 6, -1]
    texts = ["one two three " * 3000] * 200
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], ["doc_id", "text"])
    before, most, n = pa.total_allocated_bytes(), 0, 0
    for own, _ in suffix_tree._training([batch], lambda ids: np.arange(len(ids)) % 4 == 1):
        most, n = max(most, pa.total_allocated_bytes() - before), n + len(own)
    assert n == 150 * 9001 and most < batch.nbytes / 4


def test_a_scorer_goes_with_its_tree():
    """Workers kept the last tree's tables through the jobs after it."""
    some, logs = np.arange(3, dtype=np.uint64), np.zeros(3)
    hot = suffix_tree.Hot(some, logs, -1.0, 0, some, some, logs, some, logs)
    scorer = suffix_tree._worker_scorer(hot, 2)
    assert suffix_tree._worker_scorer(hot, 2) is scorer and len(suffix_tree._WORKER) == 1
    del hot
    gc.collect()
    assert not len(suffix_tree._WORKER)


def test_pairs_seen_more_than_65535_times(spark):
    rows = [row(7 * k + 1, "ping pong " * 9000) for k in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    counts = durable(suffix_tree.count_symbols(docs))
    learnt = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    key = np.unique(suffix_tree.extended(np.zeros(1, np.uint64), suffix_tree.symbols(np.frombuffer(b"ping", np.uint8), np.array([0, 4]))[0][:1]))
    words = counts.toArrow().column("symbol").to_numpy().view(np.uint64)
    got = suffix_tree._next_of_known(docs, key, np.sort(words), 1, 4, 1, suffix_tree.held_out).collect()
    assert [r["n"] for r in got] == [9000 * len(learnt)] and 9000 * len(learnt) > 65535


def test_filters_and_bounds(spark):
    """A filter stops none of its keys and few others; a bound is reached by as many rows as may be."""
    r = np.random.default_rng(6)
    keys = r.integers(0, 1 << 64, 40_000, np.uint64)
    held = suffix_tree.key_filter(spark.createDataFrame([(int(k),) for k in keys[:20_000].view(np.int64)], "key long"), "key")
    assert held.passes(keys[:20_000]).all() and held.passes(keys[20_000:]).mean() < 0.1
    assert not suffix_tree.key_filter(spark.createDataFrame([], "key long"), "key").passes(keys).any()
    table = spark.createDataFrame([(n,) for n in range(1, 101) for _ in range(1 + (n == 50))], "n long")
    assert [suffix_tree.least_of(table, "n", most) for most in (0, 1, 10, 1000)] == [1 << 62, 1 << 62, 91, 0]


def test_what_tasks_dont_hold_is_sent_packed(docs, monkeypatch):
    """Words beyond the head, contexts and symbols are picked by their own counts; what others hold comes back as one sum for a row.

    Before, the head had only words with 1 / ``head`` of all symbols, a context was held with all its symbols, and each place was joined by itself.
    """
    counts = durable(suffix_tree.count_symbols(docs))
    tree = suffix_tree.grow(docs, counts, head=40, few=30)
    numbers = sorted((x["n"] for x in counts.collect()), reverse=True)
    assert not tree.whole_head and 30 <= len(tree.head) <= 40 and sorted(tree.head_counts, reverse=True) == numbers[: len(tree.head)]
    hot = suffix_tree.hottest(tree, 60, suffix_tree.MIN_COUNT)
    times = sorted([x["size"] for x in tree.contexts.collect()] + [x["n"] for x in tree.pairs.collect()], reverse=True)
    held = len(hot.keys) + len(hot.pairs)
    assert 40 <= held <= 60 < len(times) and hot.least == times[held - 1]
    asked = []
    far_sums = suffix_tree._far_sums
    monkeypatch.setattr(suffix_tree, "_far_sums", lambda a, table, bits: asked.append((a, table, bits)) or far_sums(a, table, bits))
    scored = suffix_tree.score(docs, tree, counts, hot=60)
    ((lookups, table, bits),) = asked
    assert lookups.count() <= docs.rdd.getNumPartitions() << bits and table.count() == len(times) - held
    changes = far_sums(lookups, table, bits).collect()
    assert len({x["row"] for x in changes}) == len(changes) <= scored.count() == docs.count()
