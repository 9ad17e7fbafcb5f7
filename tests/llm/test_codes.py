"""Token-id files, byte-level BPE, media files: against the libraries and by round trips."""

import base64
import hashlib
import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import by_text, checked
from tokenizers import Tokenizer

from adlattice.llm import bpe, media, pretoken, scan, token_ids

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(RANKS))


def test_split_follows_the_pattern():
    import regex

    r = random.Random(4)
    letters = "ab'stremvld  \n\t  éß12²,.!'世界\U0001f600́\x1c\x85"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 25))) for _ in range(4000)]
    kinds = pretoken.kinds("tiktoken")
    for lo, _, data, off in scan.chunks(pa.array(texts), size=500):
        cuts = [*pretoken.split(data, off, kinds).tolist(), len(data)]
        got = [data[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:])]
        assert got == [p for t in texts[lo : lo + len(off) - 1] for p in regex.findall(public_tokenizers.PATTERN, t)]


def test_perfect_hash_has_a_slot_for_every_key(vocabulary):
    keys = [vocabulary.tokens[i] for i in vocabulary.ids]
    assert np.array_equal(vocabulary.index.find(bpe.byte_hashes(keys)), np.arange(len(keys)))
    assert np.array_equal(np.sort(vocabulary.index.slot_of), np.arange(len(keys)))


def test_round_trip_equals_the_library(spark, docs, plain):
    def expected(text):
        ids = plain.encode_ordinary(text)
        raw = np.array(ids, "<u4").tobytes()
        return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    checked(bpe.round_trip(docs, RANKS), docs, ("n_tokens", "ids_sha256", "decoded_sha256"), expected)


def test_encode_and_decode(docs, empty):
    back = bpe.decode(bpe.encode(docs, RANKS), RANKS)
    checked(back, docs, ("bytes",), lambda t: (bytearray(t.encode()),))
    assert bpe.round_trip(empty, RANKS).count() == 0


@given(st.text(max_size=40))
@settings(max_examples=150, deadline=None)
def test_merging_equals_the_library(plain, vocabulary, text):
    encoder = bpe.pieces.PieceEncoder(vocabulary.resolve, pretoken.kinds("tiktoken"))
    data, off = scan.utf8(pa.array([text]))
    ids, _ = encoder.encode(data, off)
    assert ids.tolist() == plain.encode_ordinary(text)


def test_encoder_forgets_beyond_its_bound(plain, vocabulary):
    encoder = bpe.pieces.PieceEncoder(vocabulary.resolve, pretoken.kinds("tiktoken"), kept=3)
    for text in ("one two three four", "five six", "one two"):
        data, off = scan.utf8(pa.array([text]))
        assert encoder.encode(data, off)[0].tolist() == plain.encode_ordinary(text)


@given(st.lists(st.integers(0, 300), min_size=2, max_size=60))
@settings(max_examples=100, deadline=None)
def test_code_lengths_are_optimal(counts):
    counts = np.array(counts)
    lengths = token_ids.code_lengths(counts)
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        heapq.heappush(heap, (s := heapq.heappop(heap) + heapq.heappop(heap)))
        cost += s
    if (counts > 0).sum() > 1:
        assert int((counts * lengths).sum()) == cost
    assert ((lengths > 0) == (counts > 0)).all()


def test_code_lengths_keep_the_limit():
    counts = np.array([2**k for k in range(30)])
    lengths = token_ids.code_lengths(counts, 8)
    assert lengths.max() == 8 and sum(2.0 ** -int(n) for n in lengths) <= 1
    with pytest.raises(ValueError):
        token_ids.code_lengths(np.ones(5), 2)


@given(st.lists(st.integers(0, 50), max_size=900))
@settings(max_examples=60, deadline=None)
def test_bits_round_trip(ids):
    ids = np.array(ids, np.int64)
    lengths = token_ids.code_lengths(np.bincount(ids, minlength=3))
    bits, points = token_ids.encode(ids, token_ids.canonical_codes(lengths), lengths)
    assert np.array_equal(token_ids.decode(bits, points, len(ids), token_ids.decode_table(lengths)), ids)


def test_token_files(spark, docs, empty, tmp_path):
    model = Tokenizer.from_file(MODEL)
    special = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>y <|endoftext", "\n<|endoftext|>\n", "<|endoftext|>" * 3 + " z"]
    more = [(7000 + k // 2, t, None, None, 0, 0, "", 0, "") for k, t in enumerate(special)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).repartition(2)
    got, texts = by_text(token_ids.encoded_corpus(docs, MODEL, str(tmp_path / "ids")), docs)
    rows = [r for some in got.values() for r in some]
    for key in got:
        expected = sorted((len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in ([*model.encode(t or "").ids, 0] for t in texts[key]))
        assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got[key]) == expected
    at = 0
    for r in sorted(rows, key=lambda r: (r["start"])):
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in sorted(rows, key=lambda r: r["start"])]
    assert keys == sorted(keys)
    again = token_ids.read_ids(spark, str(tmp_path / "ids"))
    assert sorted((r["start"], len(r["ids"]) // 4) for r in again.collect()) == sorted((r["start"], r["n_tokens"]) for r in rows)
    assert token_ids.encoded_corpus(empty, MODEL).count() == 0


def test_small_blocks_and_shards(spark, docs, tmp_path):
    staged = token_ids.tokenize(docs, MODEL)
    token_ids.write_ids(staged, str(tmp_path / "ids"), shard_ids=3000, block_ids=100)
    got = token_ids.read_digests(spark, str(tmp_path / "ids"))
    whole = token_ids.encoded_corpus(docs, MODEL)
    key = lambda r: (r["start"], r["n_tokens"], r["ids_crc32"])
    assert sorted(map(key, got.collect())) == sorted(map(key, whole.collect()))


def test_stored_texts(docs, empty):
    def expected(text):
        raw = text.encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        stored = media.store_samples(payload)
        return (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest())

    columns = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    checked(media.stored_texts(docs), docs, columns, expected)
    assert media.stored_texts(empty).count() == 0


@given(st.integers(1, 40), st.integers(1, 9), st.binary(min_size=40, max_size=40))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(samples, key_every, seed):
    payload = (seed * samples)[: 40 * samples]
    raw = media.store_samples(payload, frame=40, key_every=key_every)
    assert media.read_samples(raw) == payload
    (track,) = media.read_tracks(raw)
    assert track.keyframes().tolist() == list(range(0, samples, key_every))
    assert (track.codec, track.handler) == ("raw ", "soun") and media.seconds([track]) == 40 * samples / media.RATE
    at = track.offsets()[track.keyframes()]
    assert all(raw[a : a + 40] == payload[k * 40 : k * 40 + 40] for a, k in zip(at.tolist(), track.keyframes().tolist()))


def test_index_media(spark):
    good = media.store_samples(b"ab" * 576)
    files = [(1, good, 7.0), (2, None, 8.0), (3, good[:-5], 9.0), (4, b"", 0.0), (5, b"\0\0\0\x08free", 1.0), (6, b"\xff" * 50, 1.0)]
    rows = {r["id"]: r for r in media.index_media(spark.createDataFrame(files, "id long, content binary, duration_s double")).collect()}
    (track,) = rows[1]["tracks"]
    assert rows[1]["error"] is None and track["codec"] == "raw " and track["n_samples"] == 2 and track["sample_bytes"] == 1152
    assert good[track["keyframes"][0]["offset"] :][:4] == b"abab"
    assert rows[2]["tracks"] is None and rows[2]["error"] is None
    assert all(rows[k]["tracks"] == [] and rows[k]["error"] for k in (3, 4, 5, 6))


def test_index_of_lying_boxes(spark):
    import struct

    def nested(times):
        out = b""
        for _ in range(times):
            out = struct.pack(">I4s", 8 + len(out), b"moov") + out
        return out

    def movie(*boxes):
        inner = b"".join(struct.pack(">I4s", 8 + len(b), k) + b for k, b in boxes)
        trak = struct.pack(">I4s", 8 + len(inner), b"trak") + inner
        return struct.pack(">I4s", 8 + len(trak), b"moov") + trak

    sizes = movie((b"stsz", struct.pack(">III", 0, 7, 2**32 - 1)))
    duration = movie((b"mdhd", struct.pack(">IQQIQ", 1 << 24, 0, 0, 8000, 2**63 + 5)))
    number = movie((b"tkhd", struct.pack(">IIII", 0, 0, 0, 2**32 - 1)))
    files = [(k, f) for k, f in enumerate([nested(3000), sizes, duration, number, nested(20)])]
    rows = {r["id"]: r for r in media.index_media(spark.createDataFrame(files, "id long, content binary")).collect()}
    assert all(rows[k]["tracks"] == [] and rows[k]["error"] for k in (0, 1, 2))
    assert rows[3]["error"] is None and rows[3]["tracks"][0]["track_id"] == 2**32 - 1
    assert rows[4]["error"] is None and rows[4]["tracks"] == []


def test_sample_size_tables():
    import struct

    track = media.Track()
    body = struct.pack(">I3xBIBB", 0, 4, 3, 0x12, 0x30)
    media._read_box(memoryview(body), b"stz2", 0, len(body), track)
    assert track.sizes.tolist() == [1, 2, 3]
    long = struct.pack(">IIQQ", 0, 2, 5, 2**33)
    media._read_box(memoryview(long), b"co64", 0, len(long), track)
    assert track.chunk_offsets.tolist() == [5, 2**33]
