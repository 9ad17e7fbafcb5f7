"""Tokens of two tokenizers: against the libraries on whole texts, and a plain alignment."""

import bisect
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from adlattice.llm import alignment, scan

A = public_tokenizers.path("byte_bpe_50k.json")
B = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    back = {c: b for b, c in _byte_characters().items()}
    two = sentencepiece.SentencePieceProcessor(model_file=B)

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    vocab = {i: bytes(back[c] for c in t) for t, i in one.get_vocab().items() if all(c in back for c in t)}
    return one, two, vocab, piece


def _byte_characters():
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def groups_of(text, libraries):
    """[(ids of A, ids of B)] of a text, walking both token lists; None where the bytes differ."""
    one, two, vocab, piece = libraries
    if not text:
        return None
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    a_bytes, b_bytes = [vocab.get(i, b"?") for i in a], [piece(i) for i in b]
    raw = (" " + text).encode()
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return None
    ends = lambda tokens: np.cumsum([len(t) for t in tokens]).tolist()
    a_end, b_end = ends(a_bytes), ends(b_bytes)
    out, i, j = [], 0, 0
    for k, e in enumerate(a_end):
        at = bisect.bisect_left(b_end, e)
        if at < len(b_end) and b_end[at] == e:
            out.append((a[i : k + 1], b[j : at + 1]))
            i, j = k + 1, at + 1
    return out


def brute(texts, libraries):
    each = [groups_of(t, libraries) for t in texts]
    count = Counter((g[0][-1], g[1][-1]) for own in each if own for g in own)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for own in each:
        own = own or []
        pairs = [(g[0][-1], g[1][-1]) for g in own]
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own)
        best = sum(count[p] == most[p[1]] for p in pairs)
        sizes = (sum(len(g[0]) for g in own), sum(len(g[1]) for g in own), len(own), len(own))
        out.append((*sizes, best, sum(count[p] for p in pairs), hashlib.sha256(line.encode()).hexdigest() if own else ""))
    return out


ODD = ["a▁b", "x <|endoftext|> y </s> <unk> <0x41>", " ", "  ", "\n", " \r\n\t ", "a ", "  two  spaces ", "x\x00y", "é ﬁ ＡＢ", "日本語😀テ", "don't  it's 'tis"]


@pytest.mark.parametrize("head", [alignment.HEAD, 0, 40])
def test_equals_brute_force(spark, docs, libraries, head):
    rows = docs.unionByName(spark.createDataFrame([(5000 + k, t, None, None, 0, 0, "", 0, "") for k, t in enumerate(ODD)], docs.schema))
    texts = rows.select("doc_id", "text").collect()
    want = sorted(zip([str(r["doc_id"]) for r in texts], brute([r["text"] for r in texts], libraries)))
    got = alignment.alignments(rows, A, B, head=head).collect()
    assert sorted((str(r["doc_id"]), tuple(r[c] for c in COLUMNS)) for r in got) == want


def test_empty_and_blank_tables(spark, empty, docs):
    assert alignment.alignments(empty, A, B).collect() == []
    (row,) = alignment.alignments(docs.where("text IS NULL").limit(1), A, B).collect()
    assert tuple(row)[1:] == (0, 0, 0, 0, 0, 0, "")


@given(st.lists(st.text(st.sampled_from("ab é\n日▁ <>s|0\t"), max_size=30), max_size=8))
@settings(max_examples=120, deadline=None)
def test_chunks_equal_the_libraries(libraries, texts):
    one, two, lengths = alignment._encoders(open(A, encoding="utf-8").read(), open(B, "rb").read())
    data, off = scan.utf8(pa.array([" " + t for t in texts], pa.string()))
    n_a, n_b, _, _, lines = alignment.align(one.encode(data, off), two.encode(data, off), lengths, np.diff(off))
    for k, t in enumerate(texts):
        own = groups_of(t, libraries) or []
        assert (n_a[k], n_b[k]) == (sum(len(g[0]) for g in own), sum(len(g[1]) for g in own))
        assert lines[k].decode() == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own)


@given(st.lists(st.tuples(st.sets(st.integers(1, 40)), st.sets(st.integers(1, 40))), max_size=6))
@settings(max_examples=200, deadline=None)
def test_common_ends(texts):
    a, b, first, want = [], [], [0], []
    for k, (x, y) in enumerate(texts):
        base = 41 * k
        x, y = sorted({*x, 41}), sorted({*y, 41})
        want += [len(a) + i for i, e in enumerate(x) if e in y]
        a += [base + e for e in x]
        b += [base + e for e in y]
        first.append(len(a))
    got = alignment.common_ends(np.array(a, np.int64), np.array(b, np.int64), np.array(first))
    assert got.tolist() == want
    assert alignment.common_ends(np.array([5, 9]), np.array([1, 9]), np.array([0, 0, 2])).tolist() == [1]
