"""Entity-disjoint splits and their checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.functions.hashing import split_name, unit_hash, unit_hash_xxh64
from adlattice.session import by_rows


def assign_split(samples: DataFrame, ratios: Mapping[str, float], seed: int, xxh64: bool = False) -> DataFrame:
    """``samples`` with a ``split`` column; all rows of an entity share it. No shuffle."""
    draw = (unit_hash_xxh64 if xxh64 else unit_hash)(F.col("entity_id"), seed)
    return samples.withColumn("split", split_name(draw, ratios))


def label_rates(y1: str = "y1", y2: str = "y2") -> list:
    """Row count, label rates and broken funnels; ``cvr`` is per exposure, ``cvr_click`` per click."""
    clicks, buys = F.sum(F.col(y1).cast("long")), F.sum(F.col(y2).cast("long"))
    n = F.count(F.lit(1))
    return [
        n.alias("rows"),
        F.coalesce(F.try_divide(clicks, n), F.lit(0.0)).alias("ctr"),
        F.coalesce(F.try_divide(buys, n), F.lit(0.0)).alias("cvr"),
        F.coalesce(F.try_divide(F.sum((F.col(y1) * F.col(y2)).cast("long")), clicks), F.lit(0.0)).alias("cvr_click"),
        F.count_if((F.col(y2) == 1) & (F.col(y1) == 0)).alias("funnel_anomaly"),
    ]


def split_stats(split_samples: DataFrame) -> DataFrame:
    """Per split: rows, unique entities, label rates, funnel anomalies."""
    return split_samples.groupBy("split").agg(*label_rates(), F.count_distinct("entity_id").alias("unique_entity"))


def label_priors(split_samples: DataFrame, split: str = "train") -> DataFrame:
    """Click and conversion rate of the training rows."""
    return split_samples.where(F.col("split") == split).agg(*label_rates()).select("ctr", "cvr")


def split_tokens(tokens: DataFrame, split_samples: DataFrame) -> DataFrame:
    """Tokens with the split of their row; tokens of unknown rows are dropped."""
    return tokens.join(split_samples.select("row_id", "split"), "row_id")


def tokens_of_split(tokens: DataFrame, split_samples: DataFrame, split: str) -> DataFrame:
    wanted = split_samples.where(F.col("split") == split).select("row_id")
    return by_rows(tokens, ["row_id"]).join(wanted, "row_id", "left_semi")


def reconcile_split(tokens: DataFrame, assigned: DataFrame) -> DataFrame:
    """Token rows before and after the split, and their difference."""
    expected = tokens.agg(F.count(F.lit(1)).alias("n"))
    return assigned.agg(
        F.count_if(F.col("split") == "train").alias("train_token_rows"),
        F.count_if(F.col("split") == "valid").alias("valid_token_rows"),
    ).select(
        "train_token_rows",
        "valid_token_rows",
        expected.scalar().alias("expected_rows"),
        (F.col("train_token_rows") + F.col("valid_token_rows")).alias("observed_rows"),
        (F.col("train_token_rows") + F.col("valid_token_rows") - expected.scalar()).alias("diff"),
    )


def entity_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Number of entities that occur on both sides."""
    mine = left.select("entity_id").distinct()
    return mine.join(right.select("entity_id").distinct(), "entity_id", "left_semi").agg(
        F.count(F.lit(1)).alias("overlap")
    )


def require_disjoint(left: DataFrame, right: DataFrame) -> None:
    shared = entity_overlap(left, right).first()["overlap"]
    if shared:
        raise ValueError(f"{shared} entities occur on both sides of the split")
