"""Spread joins keep results whole when one key owns most rows."""

import pytest
from pyspark.sql import functions as F

from adlattice.operators import joins


@pytest.fixture(scope="module")
def sides(spark):
    rows = spark.range(6000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k")
    )
    table = spark.range(650).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v")).union(
        spark.createDataFrame([("hot", -1)], "k string, v long")
    )
    return rows, table


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_same_rows_as_a_plain_join(sides, how):
    rows, table = sides
    plain = rows.join(table, "k", how)
    spread = joins.spread_join(rows, table, ["k"], how, slot_rows=400)
    columns = sorted(plain.columns)
    assert sorted(map(tuple, spread.select(columns).collect()), key=str) == sorted(map(tuple, plain.select(columns).collect()), key=str)


def test_hot_key_lands_in_many_partitions(spark, sides):
    rows, table = sides
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.spread_join(rows, table, ["k"], "left", slot_rows=60)
        parts = joined.where("k = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts > 4


def test_slots_follow_the_rows_of_a_key(sides):
    rows, _ = sides
    assert [tuple(r) for r in joins.hot_keys(rows, ["k"], 500).collect()] == [("hot", 4)]
    assert [tuple(r) for r in joins.hot_keys(rows, ["k"], 50).collect()] == [("hot", 40)]
    assert joins.hot_keys(rows.limit(0), ["k"], 50).count() == 0


def test_slots_are_bounded(sides, monkeypatch):
    monkeypatch.setattr(joins, "MAX_HOT", 3)
    assert [tuple(r) for r in joins.hot_keys(sides[0], ["k"], 1).collect()] == []
    monkeypatch.setattr(joins, "MAX_HOT", 6)
    assert [tuple(r) for r in joins.hot_keys(sides[0], ["k"], 1).collect()] == [("hot", 2)]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_no_task_gets_the_rows_of_one_key_or_of_none(spark, how):
    """A third of the rows has one key, a third has none."""
    k = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 500))
    rows = spark.range(9000).select(F.col("id").alias("row_id"), k.alias("k"))
    table = spark.createDataFrame([("hot", 1), ("k1", 2), (None, 3)], "k string, v long")
    plain = rows.join(table, "k", how)
    saved = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for c, value in zip(saved, ("-1", "false", "16")):
            spark.conf.set(c, value)
        joined = joins.spread_join(rows, table, ["k"], how, slot_rows=100)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, plain.select(joined.columns).collect()), key=str)
    finally:
        for c, value in saved.items():
            spark.conf.set(c, value)
    assert max(sizes) < sum(sizes) / 4


def test_full_outer_is_refused(sides):
    with pytest.raises(ValueError):
        joins.spread_join(*sides, ["k"], "full_outer")


def test_checked_broadcast(spark):
    small = spark.range(10)
    assert "broadcast" in joins.checked_broadcast(small, 10)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in joins.checked_broadcast(small, 9)._jdf.queryExecution().logical().toString().lower()


def test_bytes_are_checked_before_a_broadcast(spark):
    wide = spark.range(50).select("id", F.lit("x" * 1000).alias("s"), F.array(F.lit("y" * 500)).alias("a")).repartition(2)
    from adlattice.session import durable

    kept = durable(wide)
    assert joins.fits_broadcast(kept, 50, 1 << 20) and not joins.fits_broadcast(kept, 50, 100_000)
    assert not joins.fits_broadcast(kept, 49, 1 << 20)


def test_file_tables_are_not_written_again(spark, tmp_path):
    from adlattice.session import durable

    spark.range(5).selectExpr("id", "id + 1 AS v").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    assert durable(table) is table
    part = table.select("v")
    assert durable(part) is part
    changed = table.select((F.col("v") + F.rand()).alias("v"))
    assert durable(changed) is not changed
