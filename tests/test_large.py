"""Layouts that grow with the input; bounds are lowered so that small tables are large."""

import pytest
from pyspark.sql import functions as F

from adlattice import session
from adlattice.operators import split as sp
from adlattice.operators import tokens as tk
from adlattice.plans import evaluation_queries
from adlattice.plans.views import Views
from adlattice.sources import sinks


@pytest.fixture(scope="module")
def tokens(spark, tmp_path_factory):
    """Written token rows; some repeat a key, one has none."""
    i = F.col("id")
    rows = spark.range(6000).select(
        F.when(i != 7, i % 1500).alias("row_id"), (i % 2).cast("byte").alias("src"), F.lit("853").alias("field"),
        (i % 40).cast("string").alias("fid"), (i % 17).cast("float").alias("val"), i.alias("ord"),
    )
    path = str(tmp_path_factory.mktemp("large") / "tokens")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def sizes(spark, path):
    return [r["token_rows"] for r in sinks.part_manifest(spark, path).collect()]


def test_token_files_follow_the_bytes(spark, tokens, tmp_path, monkeypatch):
    sinks.write_tokens(tokens, f"{tmp_path}/few", parts=2)
    assert len(sizes(spark, f"{tmp_path}/few")) == 2
    monkeypatch.setattr(sinks, "ROW_INPUT", session.parts_of(tokens, 1) // 10)
    sinks.write_tokens(tokens, f"{tmp_path}/many", parts=2)
    got = sizes(spark, f"{tmp_path}/many")
    assert len(got) > 8 and sum(got) == 6000 and max(got) < 2000
    assert len(sinks.compact_tokens(spark, f"{tmp_path}/many", f"{tmp_path}/compact", target_parts=2).collect()) > 2
    assert sinks.merge_parquet(spark, f"{tmp_path}/many", f"{tmp_path}/merged", 1) == 6000
    assert len(sizes(spark, f"{tmp_path}/merged")) > 1


def test_row_partitions_follow_the_bytes(spark, tokens, monkeypatch):
    assert session.by_rows(tokens, ["row_id"]) is tokens
    monkeypatch.setattr(session, "ROW_INPUT", session.parts_of(tokens, 1) // 20)
    assert session.by_rows(tokens, ["row_id"]).rdd.getNumPartitions() > 15
    laid = session.colocated(tokens.where("row_id IS NOT NULL"), ["row_id"], parts=4)
    assert session.by_rows(laid, ["row_id"]) is laid
    samples = spark.createDataFrame([(r, "train" if r % 3 else "valid") for r in range(1500)], "row_id long, split string")
    assert sp.tokens_of_split(tokens, samples, "valid").count() == tokens.where("row_id % 3 = 0").count()


def test_several_duplicate_rules_move_the_tokens_once(tokens, monkeypatch):
    many = tk.merge_duplicates(tokens, ["last", "max", "sum"], ["ord"])
    assert many._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    for rule in ("last", "max", "sum"):
        one = tk.merge_duplicates(tokens, rule, ["ord"])
        assert sorted(map(repr, one.collect())) == sorted(map(repr, many.select(*tk.TOKEN_KEY, F.col(f"{rule}_val").alias("val")).collect()))
    with pytest.raises(ValueError):
        tk.merge_duplicates(tokens, ["max", "least"])


def test_sides_hold_the_tokens_of_their_split(spark, tmp_path):
    i = F.col("id")
    tables = {
        "lineitem": spark.range(900).selectExpr("id % 300 AS l_orderkey", "id % 50 AS l_partkey", "id % 9 AS l_suppkey", "CAST(id % 7 AS DOUBLE) AS l_quantity", "'A' AS l_returnflag", "'F' AS l_linestatus", "0.05D AS l_discount"),
        "orders": spark.range(300).select(i.alias("o_orderkey"), (i % 40).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority")),
        "customer": spark.range(40).selectExpr("id AS c_custkey", "'seg' AS c_mktsegment", "id % 5 AS c_nationkey", "1.5D AS c_acctbal"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    v = Views(spark, str(tmp_path))
    v.split_samples = v.split_samples.unionByName(v.split_samples.limit(50))
    for split in ("train", "valid"):
        assert v.side(split).columns == v.tokens.columns and not v.side(split).isEmpty()
        assert sorted(map(repr, v.side(split).collect())) == sorted(map(repr, v.tokens_of(split).collect()))
    assert list(v._kept) == ["split_tokens"]


def test_given_weights_and_scores_read_lines_encoded_once(spark, tmp_path):
    i = F.col("id")
    tables = {
        "lineitem": spark.range(600).selectExpr("id % 200 AS l_orderkey", "id % 50 AS l_partkey", "id % 9 AS l_suppkey", "CAST(id % 7 AS DOUBLE) AS l_quantity", "'A' AS l_returnflag", "'F' AS l_linestatus", "0.05D AS l_discount"),
        "orders": spark.range(200).select(i.alias("o_orderkey"), (i % 40).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority")),
        "customer": spark.range(40).selectExpr("id AS c_custkey", "'seg' AS c_mktsegment", "id % 5 AS c_nationkey", "1.5D AS c_acctbal"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    v = Views(spark, str(tmp_path))
    scores = evaluation_queries.q_given_weights(v)
    assert "lineitem" not in scores._jdf.queryExecution().optimizedPlan().toString() and not any("lineitem" in f for f in scores.inputFiles())
    assert scores.count() == 200
