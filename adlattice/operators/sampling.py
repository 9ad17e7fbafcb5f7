"""Reproducible sampling of encoded or scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.functions.hashing import unit_hash

BINS = 1024


def keep_negatives(rows: DataFrame, keep_prob: float, seed: int, split: str = "train") -> DataFrame:
    """All positives, and negatives with probability ``keep_prob``; other splits stay whole.

    The draw depends on the row id alone, so a retried task keeps the same rows.
    """
    if not 0.0 <= keep_prob <= 1.0:
        raise ValueError("keep_prob must lie in [0, 1]")
    kept = (F.col("y_ctr") > 0) | (unit_hash(F.col("row_id"), seed) <= keep_prob)
    if "split" in rows.columns:
        kept = kept | (F.col("split") != split)
    return rows.where(kept)


def ratio_subset(rows: DataFrame, ratio: float, seed: int = 2026) -> DataFrame:
    if not 0.0 < ratio <= 1.0:
        raise ValueError("ratio must lie in (0, 1]")
    return rows.where(unit_hash(F.col("row_id"), seed) <= ratio)


def nth_row_id(rows: DataFrame, n: int, bins: int = BINS) -> int | None:
    """The n-th smallest row id, None where there are fewer rows; ``bins`` counts a pass reach the driver.

    Rows are counted in bins of row_id, then in finer bins of the one that holds the n-th row, until it is
    known. The range read grows narrower with every pass, and files outside it aren't read.
    """
    ends = rows.agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi"), F.count("row_id").alias("n")).first()
    if ends["n"] < n:
        return None
    lo, hi = ends["lo"], ends["hi"]
    while lo < hi:
        width = -(-(hi - lo + 1) // bins)
        inside = rows.where(F.col("row_id").between(lo, hi))
        counts = inside.groupBy(F.floor((F.col("row_id") - lo) / F.lit(width)).cast("long").alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.max("row_id").alias("last")
        )
        for r in sorted(counts.collect(), key=lambda r: r["bin"]):
            if r["n"] >= n:
                break
            n -= r["n"]
        if r["n"] == n:
            return r["last"]
        lo, hi = lo + r["bin"] * width, min(hi, lo + (r["bin"] + 1) * width - 1)
    return lo


def first_samples(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the smallest row ids: a range of row ids, so nothing is sorted or joined."""
    if n <= 0:
        raise ValueError("n must be positive")
    last = nth_row_id(rows.select("row_id"), n)
    return rows if last is None else rows.where(F.col("row_id") <= last)
