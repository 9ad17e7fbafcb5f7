"""Selection and id rules against hand-worked and brute-force results."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlattice.functions.hashing import token_bucket, token_bucket_blake2b
from adlattice.operators import encode, joins, packing, quality, sampling, vocab
from adlattice.operators.tokens import token_counts
from adlattice.session import durable
from adlattice.spec import Feature, FeatureMap, Selection, default_feature_map, feature_map_from

TOKENS = "row_id long, src tinyint, field string, fid string, val float"
SAMPLES = "row_id long, y1 tinyint, y2 tinyint, entity_id string"
BAG = dict(multi_hot=True, max_len=3, pooling="sum_sqrtn")


def run(spark, features, token_rows, sample_rows, ranks=None, **kw):
    fm = FeatureMap(tuple(features))
    tokens = spark.createDataFrame(token_rows, TOKENS)
    samples = spark.createDataFrame(sample_rows, SAMPLES)
    spec = fm.table(spark)
    ranks = vocab.frequency_ranks(token_counts(tokens)) if ranks is None else spark.createDataFrame(ranks, "src tinyint, field string, fid string, rank long")
    encoded = encode.check_bounds(encode.encode_tokens(tokens, spec, ranks, **kw))
    return fm, encoded, encode.assemble(samples, encoded, fm)


def test_missing_tokens_get_the_missing_id(spark):
    features = [
        Feature("m", 0, "vocab", vocab_tokens=2, use_value=True, **BAG),
        Feature("s", 0, "vocab", vocab_tokens=2, use_value=True),
        Feature("h", 0, "hash", hash_bucket=10),
    ]
    _, _, wide = run(spark, features, [(9, 0, "m", "a", 1.0)], [(1, 1, 0, "e")])
    row = wide.first()
    assert (row["f0_m_idx"], row["f0_m_val"], row["f0_s_idx"], row["f0_s_val"], row["f0_h_idx"]) == ([1], [1.0], 1, 1.0, 1)
    assert (row["y_ctr"], row["y_cvr"], row["y_ctcvr"], row["click_mask"]) == (1, 0, 0, 1)
    assert "f0_h_val" not in wide.columns


def test_sources_do_not_mix(spark):
    features = [Feature("f", 0, "vocab", vocab_tokens=2), Feature("f", 1, "vocab", vocab_tokens=2)]
    _, _, wide = run(spark, features, [(1, 0, "f", "a", 1.0), (1, 1, "f", "b", 1.0)], [(1, 0, 0, "e")])
    assert (wide.first()["f0_f_idx"], wide.first()["f1_f_idx"]) == (3, 3)


def test_unseen_and_tail_ids(spark):
    features = [
        Feature("v", 0, "vocab", vocab_tokens=1, **BAG),
        Feature("y", 0, "hybrid", vocab_tokens=100, hash_bucket=50, **BAG),
    ]
    ranks = [(0, "v", "a", 0), (0, "v", "b", 1), (0, "y", "a", 0)]
    rows = [(1, 0, "v", "a", 1.0), (1, 0, "v", "b", 1.0), (1, 0, "y", "a", 1.0), (1, 0, "y", "z", 1.0)]
    _, encoded, wide = run(spark, features, rows, [(1, 0, 0, "e")], ranks)
    assert wide.first()["f0_v_idx"] == [3, 2]
    head, tail = wide.first()["f0_y_idx"]
    assert head == 3 and 103 <= tail < 153
    assert {(r["fid"], r["is_oov"], r["is_tail"]) for r in encoded.collect()} == {
        ("a", False, False), ("b", True, False), ("z", False, True),
    }


def test_token_hash_depends_on_field_and_source(spark):
    rows = [(0, "205", "123"), (0, "509", "123"), (1, "205", "123")]
    df = spark.createDataFrame(rows, "src int, field string, fid string")
    got = [r[0] for r in df.select(token_bucket(F.col("src"), F.col("field"), F.col("fid"), F.lit(1000))).collect()]
    assert len(set(got)) == 3 and all(0 <= x < 1000 for x in got)
    want = [int(hashlib.md5(f"17:{s}:{f}:{t}".encode()).hexdigest()[:15], 16) % 1000 for s, f, t in rows]
    assert got == want
    exact = [r[0] for r in df.select(token_bucket_blake2b(F.col("src"), F.col("field"), F.col("fid"), F.lit(1000))).collect()]
    assert exact == [
        int.from_bytes(hashlib.blake2b(f"17:{s}:{f}:{t}".encode(), digest_size=16).digest(), "big") % 1000 for s, f, t in rows
    ]


def brute_force_selection(bag, ranks, strategy, default, k):
    """Plain statement of the selection rules for one bag of distinct tokens."""
    known = lambda t: ranks.get(t, 10**9)
    by_freq = sorted(bag, key=lambda t: (known(t), t))
    by_value = sorted(bag, key=lambda t: (-bag[t], t))
    values = np.array(list(bag.values()))
    if strategy == "auto":
        informative = np.mean(values != 1.0) >= 0.05 or values.std() >= 1e-3
        strategy = default if informative and default in ("auto_mix", "topk_by_value") else "topk_by_freq"
    if strategy == "topk_by_freq":
        return by_freq[:k], strategy
    if strategy == "topk_by_value":
        return by_value[:k], strategy
    head = by_value[: math.ceil(k * 2 / 3)]
    return head + [t for t in by_freq if t not in head][: k - len(head) if len(head) == math.ceil(k * 2 / 3) else 0], strategy


@pytest.mark.parametrize("strategy,default", [("topk_by_freq", "auto_mix"), ("topk_by_value", "auto_mix"), ("auto_mix", "auto_mix"),
                                              ("auto", "auto_mix"), ("auto", "topk_by_value"), ("auto", "topk_by_freq")])
@pytest.mark.parametrize("k", [1, 4])
def test_selection_matches_brute_force(spark, strategy, default, k):
    rng = random.Random(k)
    rows, bags = [], {}
    for rid in range(60):
        bag = {}
        for _ in range(rng.randrange(1, 9)):
            fid, val = f"t{rng.randrange(12)}", rng.choice([1.0, 1.0, 0.5, 2.0])
            rows.append((rid, 0, "f", fid, val))
            bag[fid] = max(bag.get(fid, val), val)
        bags[rid] = bag
    ranks = {f"t{i}": (7 * i) % 9 for i in range(9)}
    feature = Feature("f", 0, "hash", hash_bucket=1000, use_value=True, multi_hot=True, max_len=k, pooling="sum_sqrtn",
                      selection=Selection(strategy=strategy, default=default, k=k))
    spec = FeatureMap((feature,)).table(spark)
    table = spark.createDataFrame([(0, "f", t, r) for t, r in ranks.items()], "src tinyint, field string, fid string, rank long")
    kept = encode.select_tokens(encode.prepare_bags(spark.createDataFrame(rows, TOKENS), spec, table), spec).collect()
    for rid, bag in bags.items():
        mine = sorted((r for r in kept if r["row_id"] == rid), key=lambda r: r["pos"])
        want, rule = brute_force_selection(bag, ranks, strategy, default, k)
        assert [r["fid"] for r in mine] == want
        assert {r["rule"] for r in mine} == {rule}
        assert mine[0]["retained_frac"] == pytest.approx(len(want) / len(bag))


def test_single_hot_takes_largest_value_then_rank(spark):
    rows = [(1, 0, "s", "c", 2.0), (1, 0, "s", "b", 2.0), (1, 0, "s", "a", 1.0), (2, 0, "s", "z", 1.0), (2, 0, "s", "y", 1.0)]
    ranks = [(0, "s", "c", 0), (0, "s", "b", 5)]
    _, encoded, wide = run(spark, [Feature("s", 0, "hash", hash_bucket=99, use_value=True)], rows, [(1, 0, 0, "e"), (2, 0, 0, "e")], ranks)
    assert {r["row_id"]: r["fid"] for r in encoded.collect()} == {1: "c", 2: "y"}
    assert {r["row_id"]: r["f0_s_val"] for r in wide.collect()} == {1: 2.0, 2: 1.0}


def test_bad_values_count_and_become_zero(spark):
    rows = [(1, 0, "m", "a", float("nan")), (1, 0, "m", "b", float("inf")), (1, 0, "m", "c", 3.0), (1, 0, "m", "c", 2.0)]
    fm, encoded, wide = run(spark, [Feature("m", 0, "hash", hash_bucket=9, use_value=True, **BAG)], rows, [(1, 0, 0, "e"), (2, 0, 0, "e")])
    assert sorted(wide.where("row_id = 1").first()["f0_m_val"]) == [0.0, 0.0, 3.0]
    stats = encode.encoding_stats(encoded, fm.table(spark), spark.createDataFrame([(2,)], "n long"))
    line = stats.first().asDict()
    assert (line["rows"], line["token_rows"], line["missing"], line["total_tokens"], line["nan_inf_tokens"], line["len_sum"]) == (2, 1, 1, 4, 2, 4)
    assert encode.encoding_rates(stats).first()["nan_inf_rate"] == 0.5


def test_out_of_range_id_fails(spark):
    df = spark.createDataFrame([("f0_x", 7, 7)], "name string, idx long, total_rows long")
    with pytest.raises(Exception, match="out of range"):
        encode.check_bounds(df).collect()


def test_hot_fid_keeps_every_row(spark):
    rows = [(i, 0, "f", "hot" if i % 3 == 0 else f"t{i}", 1.0) for i in range(3000)]
    _, encoded, wide = run(spark, [Feature("f", 0, "vocab", vocab_tokens=1)], rows, [(i, 0, 0, "e") for i in range(3000)])
    assert wide.count() == 3000
    assert wide.where("f0_f_idx = 3").count() == 1000 and wide.where("f0_f_idx = 2").count() == 2000


def test_feature_map_rules():
    fm = default_feature_map()
    assert len(fm.features) == 23
    by_name = {f.name: f for f in fm}
    assert by_name["f0_853"].total_rows == 100003 + 8192 and by_name["f0_205"].total_rows == 8388610 and by_name["f1_121"].total_rows == 104
    for bad in (dict(encoding="vocab"), dict(encoding="hash"), dict(encoding="hash", hash_bucket=5, multi_hot=True), dict(encoding="x"), dict(encoding="hash", hash_bucket=5, max_len=3)):
        with pytest.raises(ValueError):
            Feature("f", 0, **bad)
    twice = Feature("f", 0, "hash", hash_bucket=5)
    with pytest.raises(ValueError):
        FeatureMap((twice, twice))
    entry = {"field": "a", "encoding": "vocab", "vocab_num_tokens": 5, "vocab_num_embeddings": 8}
    assert feature_map_from({"features": [entry]}).features[0].head_rows == 8
    with pytest.raises(ValueError):
        feature_map_from({"features": [{**entry, "vocab_num_embeddings": 9}]})


def processed(spark, rows):
    return spark.createDataFrame(rows, "row_id long, entity_id string, y_ctr tinyint, y_cvr tinyint, click_mask tinyint, f0_a_idx long, f0_b_idx array<long>, f0_b_val array<float>")


PACK = FeatureMap((Feature("a", 0, "hash", hash_bucket=99), Feature("b", 0, "hash", hash_bucket=99, use_value=True, multi_hot=True, max_len=3, pooling="sum_sqrtn")))


def test_bag_packing(spark):
    df = processed(spark, [(0, "e", 1, 1, 1, 5, [7, 8, 9, 10], [0.1, 0.2, 0.3, 0.4]), (1, "e", 0, 0, 0, 3, [], []), (2, "e", 0, 1, 0, 4, [6], [1.0]), (3, "e", 1, 0, 1, 2, [1], [1.0])])
    got = {(r["batch"], r["field"]): r for r in packing.pack_bags(df, PACK, 3).collect()}
    assert got[0, "f0_a"]["indices"] == [5, 3] and got[0, "f0_a"]["offsets"] == [0, 1] and got[0, "f0_a"]["weights"] == [1.0, 1.0]
    assert got[0, "f0_b"]["indices"] == [7, 8, 9] and got[0, "f0_b"]["offsets"] == [0, 3]
    assert got[0, "f0_b"]["weights"] == pytest.approx([0.1, 0.2, 0.3])
    assert got[1, "f0_b"]["indices"] == [1] and got[1, "f0_b"]["offsets"] == [0]


def test_padding(spark):
    df = processed(spark, [(0, "e", 1, 1, 1, 5, [7, 8], [0.5, 0.25]), (1, "e", 0, 0, 0, 3, [4], [1.0]), (2, "e", 0, 0, 0, 3, [9], [2.0])])
    got = {r["pos"]: r for r in packing.pad_batches(df, PACK, 2).collect()}
    assert (got[0]["ids"], got[1]["ids"], got[2]["ids"]) == ([7, 8], [4, 0], [9])
    assert (got[1]["weights"], got[1]["length"]) == ([1.0, 0.0], 1)


@pytest.mark.parametrize("ids", [range(40), range(-(10**12), 10**12, 10**10), [1, 2, 3, 10**15, 10**15 + 1, 10**15 + 7, 2 * 10**15]])
def test_first_samples_by_ranges(spark, ids):
    """Few bins, so that the n-th row is found over several passes; the rows are a range and nothing is sorted."""
    rows = spark.createDataFrame([(i,) for i in random.Random(1).sample(list(ids), len(ids))], "row_id long")
    for n in (1, 2, 5, len(ids) - 1, len(ids)):
        assert sampling.nth_row_id(rows, n, bins=3) == sorted(ids)[n - 1]
        assert sorted(r["row_id"] for r in sampling.first_samples(rows, n).collect()) == sorted(ids)[:n]
    assert sampling.first_samples(rows, len(ids) + 1).count() == len(ids)
    plan = sampling.first_samples(rows, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def plain_packs(rows, size, width=3):
    """Batches of sorted rows, packed one by one."""
    out = {}
    for b in range(0, len(rows), size):
        own = [r for r in sorted(rows)[b : b + size] if not (r[2] <= 0 and r[3] > 0)]
        if own:
            out[b // size, "f0_a"] = ([r[5] for r in own], list(range(len(own))), [1.0] * len(own))
            starts = [sum(len(r[6][:width]) for r in own[:k]) for k in range(len(own))]
            out[b // size, "f0_b"] = ([i for r in own for i in r[6][:width]], starts, [x for r in own for x in r[7][:width]])
    return out


@pytest.mark.parametrize("size,ids", [(7, "dense"), (7, "gaps"), (500, "gaps"), (1, "dense"), (40, "clustered"), (1000, "far")])
def test_batches_across_parts(spark, size, ids):
    r = random.Random(size)
    n = 900
    pool = {"dense": range(n), "gaps": range(5, 40 * n), "clustered": [*range(n - 1), 10**12], "far": range(-(10**15), 10**15, 10**9)}[ids]
    rows = []
    for i in pool if len(pool) == n else r.sample(pool, n):
        bag = [r.randrange(50) for _ in range(r.randrange(6))]
        rows.append((i, "e", r.randrange(2), int(r.random() < 0.3), 1, r.randrange(99), bag, [r.randrange(8) / 8 for _ in bag]))
    df = processed(spark, r.sample(rows, n)).repartition(5)
    got = {(x["batch"], x["field"]): (x["indices"], x["offsets"], x["weights"]) for x in packing.pack_bags(df, PACK, size).collect()}
    assert got == plain_packs(rows, size)
    lines = packing.pad_batches(df, PACK, size).collect()
    assert sorted(x["pos"] for x in lines) == list(range(n)) and all(x["batch"] == x["pos"] // size for x in lines)
    assert [x["ids"][: x["length"]] for x in sorted(lines, key=lambda x: x["pos"])] == [x[6][:3] for x in sorted(rows)]


def test_batches_of_no_rows_and_one_shuffle(spark):
    empty = processed(spark, [])
    assert packing.pack_bags(empty, PACK, 3).collect() == packing.pad_batches(empty, PACK, 3).collect() == []
    df = durable(processed(spark, [(i, "e", 1, 0, 1, 5, [i], [1.0]) for i in range(50)]))
    plan = packing.pack_bags(df, PACK, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("rangepartitioning") == 0


def test_dealt_bins():
    bins = [(0, 5), (1, 1), (4, 9), (5, 2), (9, 3)]
    dealt = packing.deal_bins(bins, 3, 4)
    # Two parts of 15 and 5 rows; the first takes along what its batch of rows 12 to 15 needs.
    assert [(b, p) for b, p, _, _ in dealt if p == 0][:3] == [(0, 0), (1, 0), (4, 0)]
    own = {}
    for b, p, start, stop in dealt:
        own.setdefault(p, (start, stop, []))[2].append(b)
    counts = dict(bins)
    for start, stop, mine in own.values():
        held = start + sum(counts[b] for b in mine)
        assert held >= min(20, -(-stop // 4) * 4)


def test_funnel_rules(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 0, 1), (2, 0, 0)], "row_id long, y_ctr tinyint, y_cvr tinyint")
    fixed = {r["row_id"]: r for r in quality.coerce_funnel(df).collect()}
    assert [(fixed[i]["y_cvr"], fixed[i]["y_ctcvr"], fixed[i]["click_mask"], fixed[i]["funnel_bad"]) for i in range(3)] == [(1, 1, 1, False), (0, 0, 0, True), (0, 0, 0, False)]
    assert quality.drop_broken_funnel(df).count() == 2
    with pytest.raises(ValueError):
        quality.require_rows(quality.drop_broken_funnel(df.where("row_id = 1")))


def test_quality_checks_find_faults(spark):
    df = processed(spark, [(0, "e", 1, 1, 1, 200, [2, 2], [1.0, 1.0]), (0, "e", 3, 0, 0, 1, [2], [1.0])]).withColumn("y_ctcvr", F.lit(0))
    fm = FeatureMap((Feature("a", 0, "hash", hash_bucket=99), Feature("b", 0, "vocab", vocab_tokens=9, use_value=True, **BAG), Feature("c", 0, "vocab", vocab_tokens=9)))
    report = quality.feature_report(df, fm)
    assert quality.oov_check(report).first()["failed"]
    assert quality.value_check(report).first()["failed"]
    assert {r["name"]: r["failed"] for r in quality.overflow_check(report).collect()} == {"f0_a": True, "f0_b": False}
    assert [r["name"] for r in quality.missing_columns(df, fm).collect()] == ["f0_c_idx"]
    rules = {r["rule"]: r["violations"] for r in quality.contract_check(df).collect()}
    assert rules["y_ctr in {0,1}"] == 1 and rules["row_id unique"] == 1 and rules["columns present"] == 0
    with pytest.raises(ValueError):
        quality.require_same_rows(df, df.limit(1))


def test_sampling(spark):
    rows = spark.range(4000).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("y_ctr"), F.when(F.col("id") < 2000, "train").otherwise("valid").alias("split"))
    kept = sampling.keep_negatives(rows, 0.25, 1)
    assert kept.where("y_ctr = 1").count() == 400 and kept.where("split = 'valid'").count() == 2000
    assert 350 < kept.where("y_ctr = 0 AND split = 'train'").count() < 550
    assert sampling.keep_negatives(rows, 1.0, 1).count() == 4000 and sampling.keep_negatives(rows, 0.0, 1).where("split = 'train'").count() == 200
    assert [r["row_id"] for r in sampling.first_samples(rows, 5).orderBy("row_id").collect()] == [0, 1, 2, 3, 4]
    for call in (lambda: sampling.keep_negatives(rows, 1.5, 1), lambda: sampling.ratio_subset(rows, 0.0), lambda: sampling.first_samples(rows, 0)):
        with pytest.raises(ValueError):
            call()


def test_only_tokens_beyond_the_frequent_fids_are_moved(spark, monkeypatch):
    """Ranks too many for a broadcast: fids below the head and whole small fields are found in place."""
    i = F.col("id")
    tokens = spark.range(600).select(
        i.alias("row_id"), F.lit(0).cast("byte").alias("src"), F.when(i % 3 == 0, "a").otherwise("b").alias("field"),
        F.when(i % 50 != 0, (i % 12).cast("string")).alias("fid"), F.lit(1.0).alias("val"),
    )
    lines = [("a", 0, str(3 * k), k) for k in range(2)] + [("b", 0, str(k), k) for k in range(9)]
    ranks = durable(spark.createDataFrame(lines, "field string, src byte, fid string, rank long"))
    assert joins.broadcast_head(ranks, "rank", 11) == 15 and joins.broadcast_head(ranks, "rank", 10) == 7
    assert joins.broadcast_head(ranks, "rank", 5) == 3 and joins.broadcast_head(ranks, "rank", 1) == 0
    assert joins.broadcast_groups(ranks, "field", 10) == ["a"] and joins.broadcast_groups(ranks, "field") == ["a", "b"]
    want = sorted(map(repr, vocab.look_up_ranks(tokens, ranks).collect()))
    moved = []
    monkeypatch.setattr(vocab, "fits_broadcast", lambda kept: False)
    monkeypatch.setattr(vocab, "spread_join", lambda rows, *rest: moved.append(rows.count()) or joins.spread_join(rows, *rest))
    for head in (0, 3, 7):
        monkeypatch.setattr(vocab, "broadcast_head", lambda kept, order, head=head: head)
        assert sorted(map(repr, vocab.look_up_ranks(tokens, ranks).collect())) == want
    assert moved[0] == 600 and moved[1] < 400 and moved[2] < moved[1]
