"""Column formulas shared by evaluation, losses and labels."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LOGLOSS_EPS = 1e-12
LOG_P_CEILING = -1e-7
LOG1MEXP_SWITCH = -0.6931


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def finite_or_zero(x: Column) -> Column:
    return F.when(is_finite(x), x).otherwise(F.lit(0.0))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.greatest(x, F.lit(low))
    if high is not None:
        x = F.least(x, F.lit(high))
    return x


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_sigmoid(x: Column) -> Column:
    return -softplus(-x)


def logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def joint_logit(ctr_logit: Column, cvr_logit: Column, eps: float = 1e-8) -> Column:
    """Logit of the product of both probabilities, clipped to [eps, 1 - eps]."""
    return logit(clip(sigmoid(ctr_logit) * sigmoid(cvr_logit), eps, 1.0 - eps))


def sampling_correction(keep_prob: float, exact: bool = False) -> float:
    """Shift to subtract from logits of a model trained on negatives kept with ``keep_prob``.

    The default is ln((1 - r) / r); ``exact`` gives the textbook prior shift, -ln r. Outside (0, 1)
    there is nothing to correct.
    """
    if not 0.0 < keep_prob < 1.0:
        return 0.0
    return -math.log(keep_prob) if exact else math.log((1.0 - keep_prob) / keep_prob)


def log_loss(y: Column, p: Column, eps: float = LOGLOSS_EPS) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return -(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))


def log1mexp(x: Column) -> Column:
    """ln(1 - e^x) for x < 0, by the form that keeps precision on its side of ln 2."""
    return F.when(x > LOG1MEXP_SWITCH, F.log(-F.expm1(x))).otherwise(F.log1p(-F.exp(x)))


def bce_from_log_p(log_p: Column, y: Column) -> Column:
    capped = clip(log_p, high=LOG_P_CEILING)
    return -y * capped - (F.lit(1.0) - y) * log1mexp(capped)


def bce_with_logits(x: Column, y: Column, pos_weight: Column | float = 1.0) -> Column:
    w = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    return w * y * softplus(-x) + (F.lit(1.0) - y) * softplus(x)


def focal_loss(x: Column, y: Column, gamma: float = 2.0, alpha: float | None = None) -> Column:
    p = sigmoid(x)
    p_true = clip(p * y + (F.lit(1.0) - p) * (F.lit(1.0) - y), 0.0, 1.0)
    loss = F.pow(F.lit(1.0) - p_true, F.lit(gamma)) * bce_with_logits(x, y)
    if alpha is None:
        return loss
    return (F.lit(alpha) * y + F.lit(1.0 - alpha) * (F.lit(1.0) - y)) * loss


def bin_index(x: Column, edges: list[float]) -> Column:
    """0-based bin of ``x`` among left-closed bins starting at ``edges``; -1 below the first edge.

    An explicit edge comparison: floor(x * n) misplaces doubles just below an edge.
    """
    array = F.array(*[F.lit(float(e)) for e in edges])
    return F.size(F.filter(array, lambda e: e <= x)) - 1
