"""All stages of the pipeline in a row, against plain Python stage by stage."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from llm_cases import SCHEMA, edited, prose, row

import corpus_pipeline
from adlattice.llm import pii, toxicity

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
MEAN = "zugrub"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    base = [prose(k, 80) for k in range(60)]
    rows = [row(k, t) for k, t in enumerate(base)]
    rows += [row(100 + k, edited(base[k], k, 1)) for k in range(10)] + [row(120, base[3]), row(121, base[3])]
    rows += [row(200 + k, prose(300 + k, 40) + f" {MEAN} vile{k % 3} {MEAN} " + prose(700 + k, 30)) for k in range(60)]
    passage = prose(990, 25)
    rows += [row(400 + k, prose(800 + k, 40) + f" {passage} " + prose(900 + k, 40)) for k in range(4)] + [row(410, passage)]
    rows += [row(500 + k, prose(850 + k, 30) + f" bob{k}@mail.example.com and 10.0.0.{k} " + prose(870 + k, 20)) for k in range(5)]
    rows += [row(600, None), row(601, ""), row(602, " \n "), row(None, prose(5000, 20)), row(None, None), row(603, "short text")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    marks = [(r[0], int(r[1] is not None and MEAN in r[1]), 1) for r in rows if r[0] is not None and r[0] < 300]
    spark.createDataFrame(marks, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    items = [("a", passage), ("b", prose(991, 30)), ("c", None), ("d", "")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def near_copies(rows):
    """Rows that stand for their components, by all pairs."""
    sets = []
    for r in rows:
        words = lower(r["text"] or "").split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j]["doc_id"] for j in range(len(rows)) if label[j] == label[i] and rows[j]["doc_id"] is not None]
        if (r["doc_id"] if not sets[i] else min(ids, default=None)) == r["doc_id"]:
            out.append(r)
    return out


def hit_words(text, items):
    """Places of the words that stand in a window of 10 words of an item."""
    spans = [m.span() for m in WORD.finditer(lower(text or ""))]
    words = [lower(text)[a:b] for a, b in spans]
    windows = set()
    for item in items:
        own = [m.group() for m in WORD.finditer(lower(item or ""))]
        windows |= {tuple(own[k : k + 10]) for k in range(max(1, len(own) - 9))} if own else set()
    hit = np.zeros(len(words), bool)
    for w in windows:
        for k in range(len(words) - len(w) + 1):
            if tuple(words[k : k + len(w)]) == w:
                hit[k : k + len(w)] = True
    return hit


def key(r):
    return repr((r["doc_id"], r["text"], r["lang"], r["node"], r["hits"]))


def test_stages_against_plain_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "pii", "byte_bpe"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema == docs.schema
        seen[name] = (docs.collect(), out.collect())
        docs = spark.createDataFrame(seen[name][1], docs.schema)
    before, after = seen["toxicity"]
    assert sorted(map(key, after)) == sorted(key(r) for r in before if MEAN not in (r["text"] or ""))
    before, after = seen["near_dedup"]
    assert sorted(map(key, after)) == sorted(map(key, near_copies(before)))
    before, after = seen["decontamination"]
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = {r["doc_id"]: r["text"] for r in after}
    for r in before:
        hit = hit_words(r["text"], items)
        if not hit.any():
            assert (r["doc_id"], r["text"]) in [(x["doc_id"], x["text"]) for x in after]
        elif r["doc_id"] == 410:
            assert 410 not in left
        else:
            assert not hit_words(left[r["doc_id"]], items).any()
            assert Counter(WORD.findall(lower(left[r["doc_id"]]))) == Counter(w for w, h in zip(WORD.findall(lower(r["text"])), hit) if not h)
    before, after = seen["pii"]
    texts = {}
    for r in after:
        texts.setdefault(r["doc_id"], []).append(r["text"])
    for r in before:
        spans = pii.base_spans(r["text"]) if r["text"] else []
        if not spans:
            assert r["text"] in texts[r["doc_id"]]
        else:
            assert not any(pii.base_spans(t) for t in texts[r["doc_id"]]) and "[EMAIL]" in texts[r["doc_id"]][0]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in after:
        ids = plain.encode_ordinary(r["text"] or "")
        want.append(repr((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(repr((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])) for r in got) == sorted(want)


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")) is None
