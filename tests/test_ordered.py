"""Two-level ordered scans against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlattice.operators import ordered as od


@pytest.fixture(scope="module")
def skewed(spark):
    """One group owns a third of the rows, with many ties and negative values."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else f"g{rng.randrange(20)}"
        rows.append((g, i, float(rng.randrange(-40, 40)) / 4, rng.randrange(5)))
    return rows, spark.createDataFrame(rows, "g string, i long, x double, w long").repartition(7)


def test_rank_matches_python(skewed):
    rows, df = skewed
    got = {r["i"]: r["rank"] for r in od.group_rank(df, ["g"], [F.desc("x"), "i"], partitions=9).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for at, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))):
            want[r[1]] = at
    assert got == want


def test_rank_without_group_uses_several_partitions(skewed):
    rows, df = skewed
    laid = od.lay_out(df, [], ["i"], partitions=6)
    assert laid.select(od.PID).distinct().count() > 1
    got = [r["rank"] for r in od.group_rank(df, [], ["i"], partitions=6).orderBy("i").collect()]
    assert got == list(range(len(rows)))


def test_null_group_keeps_its_rows(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 1)], "g string, i int")
    got = {(r["g"], r["i"]): r["rank"] for r in od.group_rank(df, ["g"], ["i"], partitions=3).collect()}
    assert got == {(None, 1): 0, (None, 2): 1, ("a", 1): 0}


@pytest.mark.parametrize("inclusive", [False, True])
def test_prefix_sum_and_max(skewed, inclusive):
    rows, df = skewed
    got = od.ordered_prefix(df, ["g"], ["i"], {"s": ("sum", "w"), "m": ("max", "x")}, inclusive, partitions=9)
    got = {r["i"]: (r["s"], r["m"]) for r in got.collect()}
    for g in {r[0] for r in rows}:
        total, best = 0, None
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            after = total + r[3], r[2] if best is None else max(best, r[2])
            assert got[r[1]] == (after if inclusive else (total, best))
            total, best = after


def test_value_quantiles_match_numpy(skewed):
    rows, df = skewed
    probs = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    for r in od.value_quantiles(df, ["g"], "x", probs, partitions=5).collect():
        values = [x[2] for x in rows if x[0] == r["g"]]
        np.testing.assert_allclose([r[k] for k in probs], np.quantile(values, list(probs.values())), atol=1e-12)


def test_value_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "x double")
    assert [tuple(r) for r in od.value_quantiles(df, [], "x", {"p": 0.5}).collect()] == [(None,)]


def test_count_quantiles_match_numpy(skewed):
    rows, df = skewed
    got = od.count_quantiles(df, [], "w", {"p50": 0.5, "p99": 0.99}).first()
    np.testing.assert_allclose([got["p50"], got["p99"]], np.quantile([r[3] for r in rows], [0.5, 0.99]))


@pytest.mark.parametrize("width,chunk", [(1, 1), (3, 4), (5, 5), (4, 1000)])
def test_trailing_mean(skewed, width, chunk):
    rows, df = skewed
    got = od.trailing_mean(df, ["g"], ["i"], "x", width, "ma", chunk=chunk, partitions=6)
    got = {r["i"]: r["ma"] for r in got.collect()}
    assert len(got) == len(rows)
    for g in ("hot", "g3"):
        line = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        for at, r in enumerate(line):
            assert got[r[1]] == pytest.approx(np.mean([x[2] for x in line[max(0, at - width + 1) : at + 1]]))
