"""Language identification and toxicity: held-out accuracy and defined results."""

import pickle
import random
import zlib

import numpy as np
import pytest
from llm_cases import SCHEMA, row
from pyspark import SparkContext
from pyspark.sql import functions as F

from adlattice.llm import language_id, toxicity

WORDS = {
    "en": "the of and that with from for was here only in it to as by are".split(),
    "de": "der die und nicht mit von für war hier nur im es zu als bei sind".split(),
    "fr": "le des et que avec pour était ici seul dans il à comme par sont où".split(),
}
BAD = {"en": "loser idiot scum trash".split(), "de": "trottel abschaum müll".split(), "fr": "crétin ordure minable".split()}


def labelled(n=600):
    r = random.Random(11)
    rows, labels = [], []
    for k in range(n):
        lang = r.choice(list(WORDS))
        words = [r.choice(WORDS[lang]) + r.choice(["", "", "x", "ing"]) for _ in range(r.randint(5, 80))]
        toxic = int(r.random() < 0.25)
        for _ in range(2 * toxic):
            words.insert(r.randrange(len(words)), r.choice(BAD[lang]))
        rows.append(row(k, " ".join(words), lang if r.random() < 0.9 else None, f"src{k % 3}"))
        if r.random() < 0.8:
            labels.append((k, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def texts(spark):
    rows, labels = labelled()
    odd = [row(9000, None), row(9001, ""), row(9002, "123 !! 45"), row(None, "the of and that"), row(9003, "the " * 60000), row(3, "x")]
    more = [(3, 1, 0), (3, 1, None), (None, 0, 1), (5, 0, 1)]
    return (
        spark.createDataFrame(rows + odd, SCHEMA).repartition(4),
        spark.createDataFrame(labels + more, "doc_id long, quality int, toxic int"),
        {r[0]: r for r in rows},
        {d: t for d, _, t in labels},
    )


def test_language(texts):
    docs, _, known, _ = texts
    got = language_id.identified(docs).collect()
    assert len(got) == docs.count()
    right = [r["lang_pred"] == known[r["doc_id"]][2] for r in got if r["held_out"] and r["doc_id"] in known and known[r["doc_id"]][2]]
    assert len(right) > 80 and np.mean(right) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[k]["lang_pred"] == "und" and by_id[k]["score"] == 0 for k in (9000, 9001, 9002))
    assert by_id[9003]["lang_pred"] == by_id[None]["lang_pred"] == "en"
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_language_learns_from_training_rows_alone(texts):
    docs, _, _, _ = texts
    changed = docs.selectExpr("doc_id", "text", "CASE WHEN pmod(crc32(binary(string(doc_id))), 4) = 2 THEN 'zz' ELSE lang END AS lang")
    key = lambda r: (r["doc_id"] or -1, r["lang_pred"], round(r["score"], 9))
    assert sorted(map(key, language_id.identified(docs).collect())) == sorted(map(key, language_id.identified(changed).collect()))


def test_language_sample_under_copies(spark):
    """Many copies of a few texts: every language is learnt, and no text is read twice."""
    r = random.Random(8)
    more = {"it": "il lo gli che non con della sono anche più".split()}
    rows, pool = [], WORDS | more
    for lang in pool:
        for _ in range(10):
            text = " ".join(r.choice(pool[lang]) for _ in range(25))
            rows += [row(4 * len(rows) + k, text, lang) for k in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language_id.train(docs, sample=200)
    probe = spark.createDataFrame([row(k, " ".join(pool[lang]), lang) for k, lang in enumerate(pool)], SCHEMA)
    got = {x["doc_id"]: x["lang_pred"] for x in language_id.predict(probe, model).collect()}
    assert got == dict(enumerate(pool))


def test_language_without_examples(docs, empty):
    assert {r["lang_pred"] for r in language_id.identified(docs.withColumn("lang", docs["source"]).where("false")).collect()} == set()
    none = language_id.predict(docs, language_id.train(docs.selectExpr("doc_id", "text", "string(null) AS lang")))
    assert {(r["lang_pred"], r["score"]) for r in none.collect()} == {("und", 0.0)}
    assert language_id.identified(empty).count() == 0


def test_temperature_calibrates():
    r = np.random.default_rng(2)
    p = r.dirichlet([0.4, 0.4, 0.4], 4000)
    labels = np.array([r.choice(3, p=row) for row in p])
    assert language_id.fit_temperature(np.log(p + 1e-12) * 3, labels) == pytest.approx(3, rel=0.15)


def test_elastic_net_leaves_weights_out():
    r = np.random.default_rng(3)
    rows = [(np.array([k % 2, 10 + r.integers(50)]), np.array([1.0, 0.3]), k % 2) for k in range(300)]
    loose, _ = language_id.fit_ftrl(rows, 2, l1=0.0)
    tight, _ = language_id.fit_ftrl(rows, 2, l1=1.0)
    assert (tight != 0).sum() < (loose != 0).sum()
    assert tight[0, 0] > tight[0, 1] and tight[1, 1] > tight[1, 0]


def test_toxicity(texts):
    docs, labels, known, marks = texts
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"] and r["doc_id"] in marks and r["doc_id"] not in (3, 5)]
    truth, said = np.array([marks[r["doc_id"]] for r in held]), np.array([r["predicted"] for r in held])
    assert truth.sum() > 10 and (truth == said).mean() > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (9000, 9001)}
    assert len(blank) == 1 and blank.pop() < 0.5


def test_toxicity_learns_from_training_rows_alone(texts):
    docs, labels, _, _ = texts
    flipped = labels.selectExpr("doc_id", "CASE WHEN pmod(crc32(binary(string(doc_id))), 5) = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    key = lambda r: (r["doc_id"] or -1, round(r["score"], 6))
    assert sorted(map(key, toxicity.scored(docs, labels).collect())) == sorted(map(key, toxicity.scored(docs, flipped).collect()))


def test_keep_clean(texts, empty):
    docs, labels, _, _ = texts
    model = toxicity.train(docs, labels)
    out = toxicity.keep_clean(docs, model)
    assert out.columns == docs.columns and out.count() == toxicity.score(docs, model).where("predicted = 0").count()
    assert toxicity.keep_clean(docs, None).count() == docs.count()
    assert toxicity.scored(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.scored(docs, labels.where("toxic = 0")).collect()} == {0.0}


def test_toxicity_of_odd_labels_and_repeated_rows(texts, spark):
    """Labels other than 0 and 1 are none; rows that repeat a doc_id are one example."""
    docs, labels, _, _ = texts
    odd = labels.unionByName(labels.limit(0)).selectExpr("doc_id", "toxic").unionByName(
        docs.selectExpr("doc_id + 100000 AS doc_id", "CASE WHEN doc_id % 2 = 0 THEN 2 ELSE -1 END AS toxic").limit(50)
    )
    more = docs.withColumn("doc_id", docs["doc_id"] + 100000).limit(50)
    many = docs.unionByName(more).unionByName(docs).unionByName(docs)
    key = lambda frame: {r["doc_id"]: round(r["score"], 6) for r in frame.where("doc_id < 3000").collect()}
    assert key(toxicity.scored(many, odd)) == key(toxicity.scored(docs, labels))


def test_thresholds_differ_by_language():
    r = np.random.default_rng(5)
    language, labels = np.repeat([0, 1, 2], 200), np.tile([0, 1], 300)
    logits = labels * 2 + np.repeat([0.0, 5.0, 0.0], 200) + r.normal(0, 0.1, 600)
    labels[language == 2] = 0
    thresholds, slope = toxicity.calibrate(logits, labels, np.ones(600), language, 3)
    assert 0.5 < thresholds[0] < 1.7 and 5.5 < thresholds[1] < 6.7 and slope > 0
    assert thresholds[2] == toxicity.best_threshold(logits, labels, np.ones(600))


def test_toxicity_learns_from_every_labelled_row(texts, spark, monkeypatch):
    """Shards of 100 rows: all are counted and trained on, and the result still tells the labels apart."""
    docs, labels, known, marks = texts
    met = []
    counted, fit = toxicity._counted, toxicity.fit
    monkeypatch.setattr(toxicity, "_counted", lambda examples: met.append(examples.count()) or counted(examples))
    monkeypatch.setattr(toxicity, "fit", lambda examples, *rest: met.append(examples.count()) or fit(examples, *rest))
    got = toxicity.scored(docs, labels, shard=100).collect()
    train = toxicity._examples(docs, labels).selectExpr("sum(int(pmod(xxhash64(doc_id, 31), 5) <> 0)) AS n").first()["n"]
    assert met == [train, train] and train > 300
    held = [r for r in got if r["held_out"] and r["doc_id"] in marks and r["doc_id"] not in (3, 5)]
    common = max(np.mean([marks[r["doc_id"]] == k for r in held]) for k in (0, 1))
    assert np.mean([r["predicted"] == marks[r["doc_id"]] for r in held]) > common + 0.05


def test_rare_words_among_many_examples_are_learnt(spark):
    """A word of 12 toxic rows among 8,000 of that label is told; a draw of 3,000 rows of the label met it in some 4 of them."""
    r = random.Random(2)
    train = [k for k in range(22000) if zlib.crc32(str(k).encode()) % 5]
    bad, rows, labels = set(train[::2][:8000]), [], []
    rare = set(sorted(bad)[::600])
    for k in train:
        words = [r.choice(WORDS["en"]) for _ in range(4)]
        words += ["quorvex"] * (k in rare) + ["idiot"] * (k in bad - rare)
        rows.append(row(k, " ".join(words)))
        labels.append((k, int(k in bad)))
    seen, _ = toxicity._counted(toxicity._examples(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")))
    at = toxicity.word_buckets(np.frombuffer(b"quorvex", np.uint8), np.array([0, 7]))[0][0, 0]
    assert seen[0, 1, at] == len(rare) and seen[0, 1].max() <= 8000 and len(bad) == 8000


def test_rounds_send_the_embeddings_they_met_alone(texts, spark, monkeypatch):
    """The whole network took 19 MB in each round, from the driver and back to it."""
    docs, labels, *_ = texts
    sent, got = [], []
    broadcast, applied = SparkContext.broadcast, toxicity._applied
    monkeypatch.setattr(SparkContext, "broadcast", lambda sc, value: sent.append(len(pickle.dumps(value))) or broadcast(sc, value))
    monkeypatch.setattr(toxicity, "_applied", lambda net, step, changes: got.append(changes.nbytes) or applied(net, step, changes))
    examples = toxicity._examples(docs, labels, 100)
    total = np.array([examples.where(F.col("toxic") == k).count() for k in (0, 1)])
    sent.clear()
    whole = toxicity.fit(examples, toxicity._counted(examples)[0], total, epochs=2)
    size = sum(t.nbytes for t in whole.tables)
    assert len(sent) == len(got) == 2 and max(sent + got) < size / 2 and sent[1] < size / 10
    monkeypatch.undo()
    again = toxicity.fit(examples, toxicity._counted(examples)[0], total, epochs=2)
    assert again.out_bias == whole.out_bias and all((a == b).all() for a, b in zip(again.tables, whole.tables))
