"""All stages in a row on the smallest tables, and a sample of the registered queries against SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from adlattice.operators import encode, profile, scorers
from adlattice.operators import split as sp
from adlattice.plans import source_queries as sq
from adlattice.plans import stages
from adlattice.plans.catalog import QUERIES
from adlattice.plans.views import FEATURES, Views
from adlattice.session import read_colocated
from adlattice.spec import default_feature_map
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
CHECKED = [
    "canonical_tokens", "split_stats", "fid_lift", "oov_row_curve", "value_psi", "processed_rows", "packed_bags", "roc_auc",
    "conflict_summary", "gated_best", "best_records",
]


def moved_by_row(df):
    """Whether a shuffle deals rows out by row_id."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any("row_id" in line and "hashpartitioning" in line for line in plan.splitlines())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_raw_log_to_evaluation(spark, tmp_path):
    v = Views(spark, SF)
    out = stages.Layout(str(tmp_path))
    manifest = stages.canonical(spark, sq.skeleton_path(v), sq.common_path(v), out).first()
    assert manifest["samples_rows"] == 1500 and 0.8 < manifest["join_hit_ratio"] < 1.0
    assert stages.split(spark, out, {"train": 0.8, "valid": 0.2}, 42).first()["diff"] == 0
    stages.explore(spark, out, min_support=2)
    advice = stages.advise(spark, out, default_feature_map())
    assert advice.count() == 6
    report = stages.process(spark, out, FEATURES)
    assert report.where("max_idx >= total_rows").count() == 0
    processed = spark.read.parquet(out.path("processed"))
    assert processed.count() == 1500
    samples, tokens = (read_colocated(spark, out.path(f"split_{name}")) for name in ("samples", "tokens"))
    assert not moved_by_row(sp.split_tokens(tokens.drop("split"), samples))
    spec, ranks = FEATURES.table(spark), spark.read.parquet(out.path("ranks"))
    lines = encode.encode_tokens(tokens.drop("split"), spec, ranks)
    assert not moved_by_row(lines)
    assert not moved_by_row(encode.assemble(samples, read_colocated(spark, out.path("encoded")), FEATURES))
    assert not moved_by_row(profile.row_lengths(tokens)) and not moved_by_row(profile.field_stats(tokens, samples.agg(F.count(F.lit(1)))))
    assert moved_by_row(profile.row_lengths(spark.read.parquet(out.path("tokens"))))
    scored = scorers.linear_scores(processed, FEATURES, passes=5, batches=1)
    assert scored.count() == 1500 and scored.where("ctr_logit IS NULL OR cvr_logit IS NULL").count() == 0
    summary = stages.evaluate(scored, out).first()
    assert summary["ctr_auc"] > 0.6 and summary["n"] == 1500
    # A second run keeps what is there.
    before = spark.read.parquet(out.path("samples")).count()
    stages.canonical(spark, sq.skeleton_path(v), sq.common_path(v), out, nrows=10)
    assert spark.read.parquet(out.path("samples")).count() == before


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", [q.name for q in QUERIES] if os.environ.get("ADLATTICE_ALL_QUERIES") else CHECKED)
def test_query_equals_its_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in entry.oracle_sql():
        assert got[0]
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_names_are_unique():
    names = [q.name for q in QUERIES]
    assert len(set(names)) == len(names)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_plans_prune_and_push_down(spark):
    v = Views(spark, SF)
    plan = v.samples.where(F.col("row_id") < 10).select("row_id")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(o_orderkey,10)" in plan and "ReadSchema: struct<o_orderkey:bigint>" in plan
