"""Raw readers, token parsing, layouts and logs."""

import json

import pytest
from pyspark.sql import functions as F

from adlattice.operators import tokens as tk
from adlattice.sources import logs, raw, sinks

T, FS, VS = "\x01", "\x02", "\x03"


def tok(field, fid, val):
    return f"{field}{FS}{fid}{VS}{val}"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    base = tmp_path_factory.mktemp("raw")
    skeleton = [
        f"10,1,1,0000000000000001,5,{tok('205', 'a', 1.0)}{T}{tok('301', 'b', 0.5)}",
        f"11,0,0,0000000000000002,6,{tok('205', 'c', 2)}{T}",
        "12,0,1,0000000000000003,7,",
        f"13,1,0,0000000000000004,8,{tok('205', 'a', 1.0)}{T}{T}junk",
    ]
    common = [
        f"0000000000000001,1,{tok('121', 'old', 1)}",
        f"0000000000000002,1,{tok('121', 'y', 1)}",
        f"0000000000000003,1,{tok('121', 'z', 1)}",
        f"0000000000000001,1,{tok('121', 'new', 1)}",
    ]
    (base / "sk.csv").write_text("\n".join(skeleton) + "\n")
    (base / "cf.csv").write_text("\n".join(common) + "\n")
    return base


def test_canonical_build(spark, files):
    numbered = raw.with_row_ids(spark, str(files / "sk.csv"))
    samples = raw.samples_of(numbered)
    assert dict(samples.dtypes) == {"row_id": "bigint", "y1": "tinyint", "y2": "tinyint", "entity_id": "string", "c4": "int", "c0": "bigint"}
    assert [tuple(r) for r in samples.orderBy("row_id").collect()] == [
        (0, 1, 1, "0000000000000001", 5, 10), (1, 0, 0, "0000000000000002", 6, 11),
        (2, 0, 1, "0000000000000003", 7, 12), (3, 1, 0, "0000000000000004", 8, 13),
    ]
    common = raw.read_common(spark, str(files / "cf.csv"))
    tokens = tk.all_tokens(tk.attach_common(numbered, common))
    assert dict(tokens.dtypes) == {"row_id": "bigint", "src": "tinyint", "field": "string", "fid": "string", "val": "float"}
    assert sorted(tuple(r) for r in tokens.collect()) == [
        (0, 0, "205", "a", 1.0), (0, 0, "301", "b", 0.5), (0, 1, "121", "new", 1.0),
        (1, 0, "205", "c", 2.0), (1, 1, "121", "y", 1.0), (2, 1, "121", "z", 1.0), (3, 0, "205", "a", 1.0),
    ]
    errors = tk.parse_errors(numbered)
    summary = tk.canonical_summary(numbered, common, tokens, errors).first()
    assert tuple(summary) == (4, 4, 0.75, 7, 1)


def test_empty_text_stays_empty(spark, files):
    rows = raw.read_skeleton(spark, str(files / "sk.csv")).where("c0 = 12").collect()
    assert rows[0]["feat_str"] == ""


def test_row_ids_over_many_splits(spark, tmp_path):
    for part in range(3):
        lines = [f"{part * 500 + i},0,0,e{i},1,{tok('1', 'x' * 40, 1)}" for i in range(500)]
        (tmp_path / f"part-{part}.csv").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        numbered = raw.with_row_ids(spark, str(tmp_path))
        assert numbered.rdd.getNumPartitions() > 3
        got = [(r["row_id"], r["c0"]) for r in numbered.select("row_id", "c0").orderBy("row_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [(i, i) for i in range(1500)]


def test_rows_outside_their_counted_split_fail(spark):
    splits = spark.createDataFrame([("a", 0, 10, 2, 0), ("b", 0, 20, 1, 2)], "_file string, _block long, _first long, _n long, _before long")
    rows = lambda *r: spark.createDataFrame(r, "_file string, _block long, _line long")
    good = raw.number_lines(rows(("a", 0, 10), ("a", 0, 11), ("b", 0, 20)), splits)
    assert sorted(r["row_id"] for r in good.collect()) == [0, 1, 2]
    for odd in (("a", 0, 12), ("a", 0, 9), ("a", 64, 10), ("c", 0, 0)):
        with pytest.raises(Exception, match="input splits changed"):
            raw.number_lines(rows(odd), splits).collect()
    raw.require_all_rows(good, splits)
    raw.require_all_rows(good.where("row_id < 2"), splits, 2)
    for wrong in (good.where("row_id < 2"), good.where("row_id > 0"), good.unionByName(good.limit(1))):
        with pytest.raises(ValueError, match="were counted"):
            raw.require_all_rows(wrong, splits)


def test_first_rows(spark, files):
    numbered = raw.with_row_ids(spark, str(files / "sk.csv"), nrows=2)
    assert [r["c0"] for r in numbered.orderBy("row_id").collect()] == [10, 11]


def test_malformed_row_fails(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("1,x,0,e,1,s\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        raw.read_skeleton(spark, str(tmp_path / "bad.csv")).collect()


@pytest.mark.parametrize(
    "text,value",
    [
        ("1", 1.0), (" 2.5 ", 2.5), ("-.5", -0.5), ("1e3", 1000.0), ("+7.", 7.0), ("1_000", 1000.0), ("inf", float("inf")), ("-Infinity", float("-inf")),
        ("1.0f", None), ("1d", None), ("", None), ("abc", None), ("1__0", None), ("_1", None), ("0x1p3", None),
    ],
)
def test_number_grammar(spark, text, value):
    df = spark.createDataFrame([(0, tok("f", "a", text))], "row_id long, feat_str string")
    got = [r["val"] for r in tk.parse_tokens(df).collect()]
    assert got == ([] if value is None else [value])
    assert tk.parse_errors(df).first()["parse_errors"] == (1 if value is None else 0)


def test_nan_is_a_number(spark):
    df = spark.createDataFrame([(0, tok("f", "a", "-NaN"))], "row_id long, feat_str string")
    assert tk.parse_tokens(df).where(F.isnan("val")).count() == 1


def test_separators_split_once(spark):
    text = f"f{FS}a{FS}b{VS}1{T}f{FS}a{VS}1{VS}2"
    df = spark.createDataFrame([(0, text)], "row_id long, feat_str string")
    assert [(r["fid"], r["val"]) for r in tk.parse_tokens(df).collect()] == [(f"a{FS}b", 1.0)]
    assert tk.parse_errors(df).first()["parse_errors"] == 1


def test_values_guard_and_duplicates(spark):
    rows = [(0, 0, "f", "a", float("nan")), (0, 0, "f", "a", 2.0), (0, 0, "f", "b", float("-inf")), (1, 0, "f", "a", -1.0)]
    df = spark.createDataFrame(rows, "row_id long, src tinyint, field string, fid string, val float")
    guarded = tk.guard_values(df)
    assert guarded.where("bad_value").count() == 2
    got = {(r["row_id"], r["fid"]): r["val"] for r in tk.merge_duplicates(guarded).collect()}
    assert got == {(0, "a"): 2.0, (0, "b"): 0.0, (1, "a"): -1.0}
    with pytest.raises(ValueError):
        tk.merge_duplicates(df, "last")
    with pytest.raises(ValueError):
        tk.merge_duplicates(df, "median")


@pytest.fixture(scope="module")
def token_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "tokens")
    df = spark.range(60).select(
        F.col("id").alias("row_id"), F.lit(0).alias("src"), F.lit("f").alias("field"), F.lit("a").alias("fid"), F.lit(1.0).alias("val")
    )
    sinks.write_tokens(df, path, parts=6)
    return path


def test_token_files_cover_disjoint_ranges(spark, token_dir):
    manifest = sinks.part_manifest(spark, token_dir).collect()
    assert len(manifest) == 6 and sum(r["token_rows"] for r in manifest) == 60
    for a, b in zip(manifest, manifest[1:]):
        assert a["row_id_max"] < b["row_id_min"]


def test_compaction(spark, token_dir, tmp_path):
    manifest = sinks.compact_tokens(spark, token_dir, str(tmp_path / "a"), target_parts=2).collect()
    assert len(manifest) == 2 and sum(r["token_rows"] for r in manifest) == 60
    assert sorted(r["row_id"] for r in spark.read.parquet(str(tmp_path / "a")).collect()) == list(range(60))
    manifest = sinks.compact_tokens(spark, token_dir, str(tmp_path / "b"), max_rows_per_file=25).collect()
    assert max(r["token_rows"] for r in manifest) <= 25
    with pytest.raises(ValueError):
        sinks.compact_tokens(spark, token_dir, str(tmp_path / "c"))


def test_compaction_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "row_id long, src tinyint, field string, fid string, val float")
    empty.write.parquet(str(tmp_path / "e"))
    with pytest.raises(ValueError):
        sinks.compact_tokens(spark, str(tmp_path / "e"), str(tmp_path / "f"), target_parts=2)


def test_row_range_reaches_the_scan(spark, token_dir):
    plan = tk.tokens_in_range(spark.read.parquet(token_dir), 5, 9).select("row_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row_id,5)" in text and "ReadSchema: struct<row_id:bigint>" in text
    assert plan.count() == 5


def test_metrics_log(spark, tmp_path):
    lines = [
        json.dumps({"run_id": "r", "split": "valid", "global_step": 1, "auc_ctr": 0.6}), "", "{broken",
        json.dumps({"run_id": "r", "split": "valid_decision", "global_step": 1, "should_update": True}),
    ]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    log = logs.read_metrics_log(spark, str(tmp_path / "m.jsonl"))
    assert log.count() == 2
    assert logs.valid_records(log).first()["auc_ctr"] == 0.6
    assert logs.decision_records(log).first()["should_update"]
