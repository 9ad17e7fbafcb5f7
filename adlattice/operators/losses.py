"""Training objectives computed offline over a scored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.functions.scalars import bce_from_log_p, bce_with_logits, focal_loss, log_sigmoid

# Fixed value: guard of counts and denominators.
EPS = 1e-6


def _dynamic_weights(scored: DataFrame, clip_ctr: float | None) -> DataFrame:
    y1, y2, m = (F.col(c).cast("double") for c in ("y_ctr", "y_cvr", "click_mask"))
    at_least = lambda c: F.greatest(c, F.lit(EPS))
    ctr = at_least(F.sum(1.0 - y1)) / at_least(F.sum(y1))
    cvr = at_least(F.sum((1.0 - y2) * m)) / at_least(F.sum(y2 * m))
    return scored.agg(
        F.struct(
            (F.least(ctr, F.lit(clip_ctr)) if clip_ctr is not None else ctr).alias("ctr"),
            cvr.alias("cvr"),
            F.sum(m).alias("mask_sum"),
        ).alias("w")
    )


def weighted_bce(scored: DataFrame, clip_ctr: float | None = None, static_ctr: float | None = None) -> DataFrame:
    """Click loss over all rows and conversion loss over clicked rows with neg/pos class weights."""
    weights = _dynamic_weights(scored, clip_ctr).scalar()
    y1, y2, m = (F.col(c).cast("double") for c in ("y_ctr", "y_cvr", "click_mask"))
    w_ctr = weights["ctr"]
    if static_ctr is not None:
        w_ctr = F.lit(float(static_ctr if clip_ctr is None else min(static_ctr, clip_ctr)))
    rows = scored.select(
        bce_with_logits(F.col("ctr_logit"), y1, w_ctr).alias("a"),
        (bce_with_logits(F.col("cvr_logit"), y2, weights["cvr"]) * m).alias("b"),
        w_ctr.alias("w_ctr"),
        weights["cvr"].alias("w_cvr"),
        weights["mask_sum"].alias("mask_sum"),
    )
    return rows.agg(
        F.max("w_ctr").alias("pos_weight_ctr"),
        F.max("w_cvr").alias("pos_weight_cvr"),
        F.avg("a").alias("loss_ctr"),
        F.when(F.max("mask_sum") > 0, F.sum("b") / (F.max("mask_sum") + F.lit(EPS))).otherwise(F.lit(0.0)).alias("loss_cvr"),
        F.max("mask_sum").alias("mask_sum"),
    )


def joint_loss(scored: DataFrame, pos_weight: float = 1.0, clip: float | None = None) -> DataFrame:
    """Exposure-level conversion loss from ln sigma(ctr) + ln sigma(cvr)."""
    weight = min(pos_weight, clip) if clip is not None and clip > 0 else pos_weight
    y = F.col("y_ctcvr").cast("double")
    loss = bce_from_log_p(log_sigmoid(F.col("ctr_logit")) + log_sigmoid(F.col("cvr_logit")), y)
    return scored.agg(F.avg(loss * F.when(y > 0.5, F.lit(float(weight))).otherwise(F.lit(1.0))).alias("loss_ctcvr"))


def focal_metric(scored: DataFrame, logit: str, label: str, gamma: float = 2.0, alpha: float | None = None) -> DataFrame:
    loss = focal_loss(F.col(logit), F.col(label).cast("double"), gamma, alpha)
    return scored.agg(F.avg(loss).alias("focal_loss"))
