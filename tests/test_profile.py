"""Splits, profiles, drift and shape on small and odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlattice.functions.hashing import cumulative_ratios, unit_hash, unit_hash_xxh64
from adlattice.operators import profile as pf
from adlattice.operators import shape, vocab
from adlattice.operators import split as sp
from adlattice.operators.tokens import token_counts

TOKENS = "row_id long, src tinyint, field string, fid string, val float"


@pytest.fixture(scope="module")
def train(spark):
    rows = [(0, 0, "f1", "a", 1.0), (0, 1, "f1", "b", 2.0), (1, 0, "f2", "c", 1.0), (2, 0, "f1", "a", 1.0), (2, 0, "f2", "c", 1.0), (3, 1, "f3", "d", 0.5)]
    return spark.createDataFrame(rows, TOKENS)


@pytest.fixture(scope="module")
def valid(spark):
    return spark.createDataFrame([(4, 0, "f1", "a", 1.0), (4, 0, "f2", "x", 1.0), (5, 1, "f3", "z", 1.5)], TOKENS)


def n(spark, k):
    return spark.createDataFrame([(k,)], "n long")


def test_split_is_disjoint_and_whole(spark):
    rows = [(i, 0, 0, e, 1, 1) for i, e in enumerate(["e1", "e2", "e1", "e3", "e2", "e4"])]
    samples = spark.createDataFrame(rows, "row_id long, y1 int, y2 int, entity_id string, c4 int, c0 long")
    got = sp.assign_split(samples, {"train": 0.5, "valid": 0.5}, 42)
    assert got.count() == 6
    sides = [got.where(F.col("split") == s) for s in ("train", "valid")]
    assert sp.entity_overlap(*sides).first()["overlap"] == 0
    sp.require_disjoint(*sides)
    with pytest.raises(ValueError):
        sp.require_disjoint(samples, samples)


def test_ratios():
    assert cumulative_ratios({"a": 2, "b": 1, "c": 1}) == [("a", 0.5), ("b", 0.75), ("c", 1.0)]
    with pytest.raises(ValueError):
        cumulative_ratios({"a": 0.0})


def test_draws_are_uniform_and_stable(spark):
    df = spark.range(4000).select(unit_hash(F.col("id"), 1).alias("u"), unit_hash_xxh64(F.col("id"), 1).alias("x"))
    got = df.agg(F.min("u"), F.max("u"), F.avg("u"), F.avg("x")).first()
    assert 0 <= got[0] and got[1] < 1 and abs(got[2] - 0.5) < 0.03 and abs(got[3] - 0.5) < 0.03


def test_token_split(spark):
    tokens = spark.range(10).select(F.col("id").alias("row_id"))
    samples = spark.range(8).select(F.col("id").alias("row_id"), F.when(F.col("id") < 5, "train").otherwise("valid").alias("split"))
    assert sp.tokens_of_split(tokens, samples, "train").count() == 5
    got = sp.reconcile_split(tokens, sp.split_tokens(tokens, samples)).first()
    assert (got["train_token_rows"], got["valid_token_rows"], got["diff"]) == (5, 3, -2)


def test_field_stats(spark, train):
    got = {(r["field"], r["src"]): r for r in pf.field_stats(train, n(spark, 4)).collect()}
    assert len(got) == 4
    f1 = got["f1", 0]
    assert (f1["token_rows"], f1["row_coverage"], f1["coverage_rate"], f1["fid_distinct"], f1["dup_rate"]) == (2, 2, 0.5, 1, 0.0)
    assert got["f3", 1]["val_non1_ratio"] == 1.0
    approx = {(r["field"], r["src"]): r["fid_distinct"] for r in pf.field_stats(train, n(spark, 4), exact=False).collect()}
    assert approx == {k: v["fid_distinct"] for k, v in got.items()}


def test_duplicates_show_in_dup_rate(spark):
    df = spark.createDataFrame([(0, 0, "f", "a", 1.0)] * 3 + [(1, 0, "f", "a", 1.0)], TOKENS)
    assert pf.field_stats(df, n(spark, 2)).first()["dup_rate"] == 0.5


def test_drift_with_missing_fields(spark, train, valid):
    coverage = pf.coverage_drift(train, valid, n(spark, 4), n(spark, 2))
    top = lambda df: pf.field_top_k(token_counts(df), 100)
    got = {(r["field"], r["src"]): r for r in pf.drift_summary(coverage, pf.top_jaccard(top(train), top(valid))).collect()}
    assert got["f1", 1]["coverage_valid"] == 0.0 and got["f1", 1]["topk_jaccard"] == 0.0
    assert got["f1", 0]["topk_jaccard"] == 1.0 and got["f1", 0]["coverage_diff"] == 0.0


def test_lift_of_zero_rate(spark, train):
    samples = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 0, 0), (3, 0, 0)], "row_id long, y1 int, y2 int")
    labelled = pf.labelled_top_tokens(train, pf.field_top_k(token_counts(train), 10), samples)
    got = {(r["field"], r["src"], r["fid"]): r for r in pf.fid_lift(labelled, samples, 1).collect()}
    assert got["f1", 1, "b"]["lift_ctr"] == 2.0 and got["f1", 0, "a"]["lift_ctr"] == 1.0 and got["f1", 1, "b"]["lift_cvr"] == 0.0
    assert pf.fid_lift(labelled, samples, 2).count() == 2


def test_top_share_uses_ceil_and_at_least_one(spark):
    df = spark.createDataFrame([(f"e{i % 150}",) for i in range(300)] + [("e0",)] * 50, "entity_id string")
    got = pf.top_share_coverage(df).first()
    assert (got["unique_entity"], got["top_entities"]) == (150, 2)
    assert got["top_coverage"] == pytest.approx((52 + 2) / 350)


def test_row_length_bins(spark):
    rows = [(r, 0, "f", str(i), 1.0) for r, size in enumerate([9, 10, 19, 20]) for i in range(size)]
    got = pf.row_length_histogram(spark.createDataFrame(rows, TOKENS)).orderBy("bin_left").collect()
    assert [r["count_rows"] for r in got] == [1, 2, 1] + [0] * 9 and got[-1]["bin_right"] is None


def test_ranks_break_ties_by_fid(spark):
    rows = [(i, 0, "f", f, 1.0) for i, f in enumerate("bbaaccd")]
    got = {r["fid"]: r["rank"] for r in vocab.frequency_ranks(token_counts(spark.createDataFrame(rows, TOKENS)), partitions=3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_oov_curves_by_hand(spark, train, valid):
    curves = vocab.oov_curves(valid, vocab.train_frequency(train), [1, 10])
    got = {(r["field"], r["src"], r["head_size"]): (r["oov_token_rate"], r["oov_row_rate"], r["new_value_rate"]) for r in curves.collect()}
    assert got["f1", 0, 1] == (0.0, 0.0, 0.0) and got["f2", 0, 10] == (1.0, 1.0, 1.0)
    advice = {(r["field"], r["src"]): (r["recommended_encoding"], r["recommended_head_size"]) for r in vocab.encoding_advice(curves).collect()}
    assert advice["f1", 0] == ("vocab", 1) and advice["f3", 1] == ("hash", None)


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_top_k_by_groups(spark, fan):
    rows = [(f, 0, f"v{i}", (i * 7919) % 23) for f in "xy" for i in range(300)]
    counts = spark.createDataFrame(rows, "field string, src tinyint, fid string, cnt long")
    got = sorted((r["field"], r["rn"], r["fid"], r["cnt"]) for r in pf.field_top_k(counts, 5, fan).collect())
    best = lambda f: sorted((r for r in rows if r[0] == f), key=lambda r: (-r[3], r[2]))[:5]
    assert got == [(f, k, r[2], r[3]) for f in "xy" for k, r in enumerate(best(f), 1)]
    levels = pf.field_top_k(counts, 5, fan)._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit [")
    assert levels >= {2: 3, 3: 2, 64: 1}[fan]


def test_cube_equals_numpy(spark):
    r = np.random.default_rng(4)
    vals = np.round(r.normal(0, 1, 400), 1).astype(np.float32)
    side = np.where(r.random(400) < 0.7, "train", "valid")
    rows = [(k, 0, "f", "a", float(v), s) for k, (v, s) in enumerate(zip(vals, side))] + [(900, 0, "g", "a", 1.0, "train"), (901, 0, "f", "a", 5.0, "other")]
    cube = shape.value_cube(spark.createDataFrame(rows, f"{TOKENS}, split string"))
    assert [tuple(x) for x in shape.cube_fields(cube).collect()] == [("f", 0)]
    edges = shape.cube_edges(cube, shape.cube_fields(cube)).first()["edges"]
    train, valid = (vals[side == s].astype(float) for s in ("train", "valid"))
    assert edges == pytest.approx(sorted(set(np.quantile(train, np.arange(1, 10) / 10))))
    bins = {x["bin"]: (x["train_frac"], x["valid_frac"]) for x in shape.cube_histogram(cube, shape.cube_edges(cube, shape.cube_fields(cube))).collect()}
    place = lambda v: np.searchsorted(edges, v, "right")
    for b in range(len(edges) + 1):
        assert bins[b] == pytest.approx(((place(train) == b).mean(), (place(valid) == b).mean()))
    got = shape.cube_profile(cube, shape.cube_fields(cube)).first()
    assert (got["train_p50"], got["valid_p99"]) == pytest.approx((np.quantile(train, 0.5), np.quantile(valid, 0.99)))
    assert got["valid_total"] == len(valid) and got["train_neg_ratio"] == pytest.approx((train < 0).mean())


def test_psi_of_a_constant_field(spark):
    make = lambda vals: spark.createDataFrame([(i, 0, "f", "a", float(v)) for i, v in enumerate(vals)], TOKENS)
    a, b = make([2.0] * 5), make([2.0, 2.0, 3.0, 1.0])
    fields = spark.createDataFrame([("f", 0)], "field string, src tinyint")
    edges = shape.decile_edges(a, fields)
    assert edges.first()["edges"] == [2.0]
    bins = {r["bin"]: (r["train_frac"], r["valid_frac"]) for r in shape.value_histogram(a, b, edges).collect()}
    assert bins == {0: (0.0, 0.25), 1: (1.0, 0.75)}
    assert shape.psi(shape.value_histogram(a, a, edges)).first()["psi"] == 0.0
    assert shape.psi(shape.value_histogram(a, b, edges)).first()["psi"] > 0


def test_histogram_when_one_side_lacks_the_field(spark):
    a = spark.createDataFrame([(0, 0, "f", "a", 1.0), (1, 0, "f", "a", 2.0)], TOKENS)
    edges = shape.decile_edges(a, spark.createDataFrame([("f", 0)], "field string, src tinyint"))
    got = shape.value_histogram(a, a.where("row_id > 9"), edges)
    assert got.agg(F.sum("train_frac"), F.sum("valid_frac")).first()[:] == (1.0, 0.0)


def test_profile_counts_special_values(spark):
    vals = [float("nan"), float("inf"), float("-inf"), 0.0, -1.0, 4.0]
    a = spark.createDataFrame([(i, 0, "f", "a", v) for i, v in enumerate(vals)], TOKENS)
    fields = spark.createDataFrame([("f", 0)], "field string, src tinyint")
    got = shape.value_profile(a, a.where("row_id = 3"), fields).first()
    assert got["train_nan_ratio"] == pytest.approx(1 / 6) and got["train_inf_ratio"] == pytest.approx(2 / 6)
    assert got["train_neg_ratio"] == pytest.approx(2 / 6) and got["train_max"] == 4.0 and got["train_p50"] == 0.0 and got["valid_zero_ratio"] == 1.0


def test_max_len_falls_back_to_the_best_k(spark):
    shares = spark.createDataFrame([("f", 0, 0.5), ("g", 0, 0.1)], "field string, src tinyint, token_share double")
    curve = spark.createDataFrame([(f, 0, k, frac, frac) for f in "fg" for k, frac in ((10, 0.3), (60, 0.8), (80, 0.999))], "field string, src tinyint, k int, retained_token_frac double, retained_row_full_frac double")
    quantiles = spark.createDataFrame([("f", 0, 70.0), ("g", 0, 70.0)], "field string, src tinyint, p99 double")
    got = {r["field"]: r["max_len"] for r in shape.max_len_advice(shares, curve, quantiles).collect()}
    assert got == {"f": 60, "g": 80}


def test_xxh64_of_many_messages():
    import pandas as pd
    import xxhash

    from adlattice.functions import digests

    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("aé1:日"), n)) for n in [*range(140), 500, 1000] for _ in range(3)]
    got = digests.by_length(pd.Series(texts), digests.xxh64)
    assert got.tolist() == [xxhash.xxh64(t).intdigest() for t in texts]
    assert digests.by_length(pd.Series([], dtype=str), digests.xxh64).tolist() == []
