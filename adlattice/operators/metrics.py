"""Evaluation of scored tables: AUC, log loss, calibration, funnel consistency."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlattice.functions.scalars import bin_index, joint_logit, log_loss, sampling_correction, sigmoid
from adlattice.operators.ordered import ordered_prefix, value_quantiles

# Fixed values.
ECE_BINS = 20
RELIABLE_POSITIVES = 100
AUC_WEIGHTS = {"auc_ctcvr": 1.0, "auc_ctr": 0.2, "auc_cvr": 0.2}
GAP_PROBS = {"gap_p50": 0.5, "gap_p90": 0.9, "gap_p99": 0.99}


def clicked(df: DataFrame, mask: str = "click_mask") -> DataFrame:
    """Rows inside the mask."""
    return df.where(F.col(mask) > 0.5)


def score_tasks(scored: DataFrame, keep_prob: float = 1.0, exact_correction: bool = False) -> DataFrame:
    """Long form of a scored table: one line per (row, task) with label ``y``, logit and probability.

    ctr and ctcvr cover every exposure, cvr the clicked rows. ``keep_prob`` corrects the click logit
    for negative down-sampling.
    """
    ctr = F.col("ctr_logit") - F.lit(sampling_correction(keep_prob, exact_correction))
    cvr = F.col("cvr_logit")
    task = lambda name, y, x: F.struct(
        F.lit(name).alias("task"), F.col(y).cast("double").alias("y"), x.alias("logit")
    )
    every = F.array(task("ctr", "y_ctr", ctr), task("ctcvr", "y_ctcvr", joint_logit(F.col("ctr_logit"), cvr)))
    lines = F.when(F.col("click_mask") > 0.5, F.concat(every, F.array(task("cvr", "y_cvr", cvr)))).otherwise(every)
    keys = [c for c in ("model", "split") if c in scored.columns]
    return scored.select(*keys, F.inline(lines)).withColumn("p", sigmoid(F.col("logit")))


def auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Exact ROC-AUC with tied scores at half weight; NULL when a class is missing.

    Rows are collapsed to one per distinct score before anything is ordered, and the number of
    negatives below a score is cumulated over range partitions instead of one global window.
    """
    y = F.col(label).cast("double")
    hist = df.groupBy(*keys, score).agg(
        F.sum(F.when(y > 0.5, 1).otherwise(0)).alias("_pos"), F.sum(F.when(y > 0.5, 0).otherwise(1)).alias("_neg")
    )
    ordered = ordered_prefix(hist, list(keys), [score], {"_below": ("sum", "_neg")}, partitions=partitions)
    won = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / F.lit(2.0)))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return ordered.groupBy(*keys).agg(F.try_divide(won, pairs).alias("auc"))


def basic_metrics(df: DataFrame, keys: Sequence[str] = (), label: str = "y", prob: str = "p") -> DataFrame:
    """Log loss, positive rate, mean prediction and row count."""
    y, p = F.col(label).cast("double"), F.col(prob)
    return df.groupBy(*keys).agg(
        F.avg(log_loss(y, p)).alias("logloss"),
        F.avg(y).alias("pos_rate"),
        F.avg(p).alias("pred_mean"),
        F.count(F.lit(1)).alias("n"),
    )


def binary_metrics(df: DataFrame, keys: Sequence[str] = (), label: str = "y", prob: str = "p") -> DataFrame:
    """``basic_metrics`` plus AUC. Over no rows every metric is NULL and ``n`` is 0."""
    base, ranked = basic_metrics(df, keys, label, prob), auc(df, label, prob, keys)
    if keys:
        return base.join(ranked, list(keys), "left")
    return base.withColumn("auc", ranked.scalar())


def bin_edges(n_bins: int = ECE_BINS) -> list[float]:
    """Left edges of equal bins, as multiples of the step in double arithmetic."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)]


def reliability(
    df: DataFrame, label: str = "y", prob: str = "p", n_bins: int = ECE_BINS, keys: Sequence[str] = ()
) -> DataFrame:
    """Per probability bin: rows, mean prediction, mean label, gap. Empty bins stay, with NULL means.

    A bin is closed on the left; the last one also on the right.
    """
    edges = bin_edges(n_bins)
    bins = df.sparkSession.createDataFrame(
        [(i, left, right) for i, (left, right) in enumerate(zip(edges, [*edges[1:], 1.0]))],
        "bin int, bin_left double, bin_right double",
    )
    y, p = F.col(label).cast("double"), F.col(prob)
    got = df.groupBy(*keys, bin_index(p, edges).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("avg_pred"), F.avg(y).alias("avg_label")
    )
    if keys:
        # One line per evaluated group times a fixed number of bins.
        every = got.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
        bins = every.join(F.broadcast(bins), "bin")
    return bins.join(got, [*keys, "bin"], "left").select(
        *keys,
        "bin_left",
        "bin_right",
        F.coalesce("n", F.lit(0)).alias("n"),
        "avg_pred",
        "avg_label",
        F.abs(F.col("avg_pred") - F.col("avg_label")).alias("abs_gap"),
    )


def ece(bins: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error of a reliability table; NULL over no rows."""
    weighted = F.sum(F.col("n") * F.coalesce("abs_gap", F.lit(0.0)))
    return bins.groupBy(*keys).agg(F.try_divide(weighted, F.sum("n")).alias("ece"))


def funnel_consistency(
    scored: DataFrame, head: str | None = None, label: str | None = "y_ctcvr", keys: Sequence[str] = ()
) -> DataFrame:
    """Gap between pred_ctr * pred_cvr and the joint head's prediction, or else the joint label."""
    target = head if head and head in scored.columns else label if label and label in scored.columns else None
    product = F.col("pred_ctr") * F.col("pred_cvr")
    if target is None:
        empty = [F.lit(None).cast("double").alias(c) for c in ("mean_y_ctcvr", "gap_mean", *GAP_PROBS)]
        return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(product).alias("mean_pred_ctcvr")).select("*", *empty)
    rows = scored.select(*keys, product.alias("joint"), F.col(target).cast("double").alias("target")).withColumn(
        "gap", F.col("joint") - F.col("target")
    )
    means = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("joint").alias("mean_pred_ctcvr"),
        F.avg("target").alias("mean_y_ctcvr"),
        F.avg("gap").alias("gap_mean"),
    )
    quantiles = value_quantiles(rows, keys, "gap", GAP_PROBS)
    if keys:
        return means.join(quantiles, list(keys), "left")
    whole = means.withColumn("_q", quantiles.select(F.struct(*GAP_PROBS).alias("q")).scalar())
    return whole.select("n", "mean_pred_ctcvr", "mean_y_ctcvr", "gap_mean", "_q.*")


def predictions(scored: DataFrame) -> DataFrame:
    """Prediction table: probabilities of both heads and their product, as floats."""
    ctr, cvr = sigmoid(F.col("ctr_logit")), sigmoid(F.col("cvr_logit"))
    return scored.select(
        "entity_id", "row_id", "y_ctr", "y_cvr", "click_mask", "y_ctcvr",
        ctr.cast("float").alias("pred_ctr"),
        cvr.cast("float").alias("pred_cvr"),
        (ctr * cvr).cast("float").alias("pred_ctcvr"),
    )


def evaluation_summary(scored: DataFrame, keys: Sequence[str] = (), keep_prob: float = 1.0) -> DataFrame:
    """CTR, masked CVR and CTCVR metrics, both calibration errors and the funnel gaps, one row per group."""
    tasks = score_tasks(scored, keep_prob)
    by = [*keys, "task"]
    lines = binary_metrics(tasks, by).join(ece(reliability(tasks, keys=by), by), by)
    pick = lambda task, metric: F.max(F.when(F.col("task") == task, F.col(metric)))
    names = {"ctr": "ctr", "cvr": "cvr_masked", "ctcvr": "ctcvr"}
    ctr, cvr = F.col("ctr_logit") - F.lit(sampling_correction(keep_prob)), F.col("cvr_logit")
    heads = scored.select(*keys, "y_ctcvr", sigmoid(ctr).alias("pred_ctr"), sigmoid(cvr).alias("pred_cvr"))
    names_of_gaps = [F.col(c).alias(f"funnel_{c}") for c in ("gap_mean", *GAP_PROBS)]
    gaps = funnel_consistency(heads, keys=keys).select(*keys, *names_of_gaps)
    by_task = lines.groupBy(*keys).agg(
        pick("ctr", "auc").alias("ctr_auc"),
        pick("cvr", "auc").alias("cvr_auc_masked"),
        pick("ctcvr", "auc").alias("ctcvr_auc"),
        pick("ctr", "logloss").alias("ctr_logloss"),
        pick("cvr", "logloss").alias("cvr_logloss_masked"),
        pick("ctcvr", "logloss").alias("ctcvr_logloss"),
        pick("ctr", "ece").alias("ece_ctr"),
        pick("cvr", "ece").alias("ece_cvr_masked"),
        F.coalesce(pick("ctr", "n"), F.lit(0)).alias("n"),
        F.coalesce(pick("cvr", "n"), F.lit(0)).alias("n_masked"),
        *[pick(t, "pos_rate").alias(f"{name}_pos_rate") for t, name in names.items()],
        *[pick(t, "pred_mean").alias(f"{name}_pred_mean") for t, name in names.items()],
    )
    if keys:
        return by_task.join(gaps, list(keys), "left")
    return by_task.withColumn("_gaps", gaps.select(F.struct("*")).scalar()).select("*", "_gaps.*").drop("_gaps")


def component_stats(df: DataFrame, parts: Sequence[str], total: str) -> DataFrame:
    """Spread of each score component, its variance share and its correlation with the total."""
    stats = [
        F.struct(
            F.lit(c).alias("component"),
            F.avg(c).alias("mean"),
            F.stddev_pop(c).alias("std"),
            F.min(c).alias("min"),
            F.max(c).alias("max"),
            F.try_divide(F.var_pop(c), F.var_pop(total)).alias("var_ratio"),
            F.corr(c, total).alias("corr_with_total"),
        )
        for c in [*parts, total]
    ]
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def label_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Positives and rates per task, and whether there are enough of them to trust a metric."""
    n = F.count(F.lit(1))
    click = F.col("click_mask") > 0.5
    got = df.groupBy(*keys).agg(
        n.alias("n"),
        F.count_if(F.col("y_ctr") > 0.5).alias("ctr_pos"),
        F.count_if(click & (F.col("y_cvr") > 0.5)).alias("cvr_pos_masked"),
        F.count_if(F.col("y_ctcvr") > 0.5).alias("ctcvr_pos"),
        F.count_if(click).alias("masked_n"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return got.select(
        *keys,
        "ctr_pos",
        rate("ctr_pos", "n").alias("ctr_pos_rate"),
        "cvr_pos_masked",
        rate("cvr_pos_masked", "masked_n").alias("cvr_pos_rate_masked"),
        "ctcvr_pos",
        rate("ctcvr_pos", "n").alias("ctcvr_pos_rate"),
        "masked_n",
        (F.col("cvr_pos_masked") >= RELIABLE_POSITIVES).alias("cvr_metric_reliable"),
        (F.col("ctcvr_pos") >= RELIABLE_POSITIVES).alias("ctcvr_metric_reliable"),
    )


def logit_stats(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, range and outer percentiles per group."""
    base = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")
    )
    return base.join(value_quantiles(df, list(keys), value, {"p01": 0.01, "p99": 0.99}), list(keys), "left")


def prob_stats(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    base = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return base.join(value_quantiles(df, list(keys), value, {"p01": 0.01, "p99": 0.99}), list(keys), "left")


def auc_primary(ctcvr: Column, ctr: Column, cvr: Column) -> Column:
    """Weighted sum when all three exist, else the mean of ctr and cvr as far as present."""
    weighted = AUC_WEIGHTS["auc_ctcvr"] * ctcvr + AUC_WEIGHTS["auc_ctr"] * ctr + AUC_WEIGHTS["auc_cvr"] * cvr
    found = F.filter(F.array(ctr, cvr), lambda v: v.isNotNull())
    mean = F.try_divide(F.aggregate(found, F.lit(0.0), lambda a, v: a + v), F.size(found))
    return F.coalesce(weighted, mean)


# Clearer column names and the older ones they copy.
METRIC_ALIASES = {
    "loss_ctcvr": "loss_cvr",
    "auc_cvr_click": "auc_cvr",
    "n_exposure": "n_rows",
    "n_exposure_batch": "mask_cvr_sum",
    "n_click": "n_masked_train",
    "n_cvr_pos_click": "pos_masked_train",
}


def with_aliases(metrics: DataFrame, aliases: Mapping[str, str] = METRIC_ALIASES) -> DataFrame:
    """Copies of older columns under clearer names; existing columns are left alone."""
    fresh = {new: F.col(old) for new, old in aliases.items() if old in metrics.columns and new not in metrics.columns}
    return metrics.withColumns(fresh) if fresh else metrics
