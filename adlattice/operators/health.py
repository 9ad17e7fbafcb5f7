"""Routing and representation health from logged gate weights, expert outputs and gradient samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlattice.functions.arrays import dot
from adlattice.operators.joins import lookup_join
from adlattice.operators.ordered import group_rank, ordered_prefix, value_quantiles

# Fixed values.
ENTROPY_EPS = 1e-12
COUNT_EPS = 1e-8
DEAD_SHARE = 0.01
MONOPOLY_SHARE = 0.8
IMBALANCE_GINI = 0.5
SPARSE_ABS = 1e-5
COLLAPSE_SIMILARITY = 0.95
EMA_ALPHA = 0.1


def entropy(weights: Column) -> Column:
    """-sum p ln p with p floored at 1e-12."""
    floor = lambda p: F.greatest(p, F.lit(ENTROPY_EPS))
    return -F.aggregate(weights, F.lit(0.0), lambda acc, p: acc + floor(p) * F.log(floor(p)))


def top1(weights: Column) -> Column:
    """0-based position of the first largest weight."""
    return (F.array_position(weights, F.array_max(weights)) - 1).cast("int")


def gate_summary(gates: DataFrame) -> DataFrame:
    """Per (task, expert): mean weight, share of rows where it is the largest, mean entropy of the task."""
    rows = gates.select("task", entropy(F.col("w")).alias("h"), top1(F.col("w")).alias("best"), F.posexplode("w").alias("expert", "p"))
    return rows.groupBy("task", "expert").agg(
        F.avg("p").alias("gate_mean"),
        F.avg((F.col("best") == F.col("expert")).cast("double")).alias("top1_share"),
        F.avg("h").alias("entropy_mean"),
        F.count(F.lit(1)).alias("n"),
    )


def gini(lines: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Gini coefficient of a non-negative value per group; 0 for fewer than two lines or no mass.

    Lines without a value don't count. Equal values are collapsed before anything is ordered, and
    the lines below a value are cumulated over range partitions: a group, and a value, may be of any size.
    """
    hist = lines.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ordered_prefix(hist, group, [value], {"_below": ("sum", "_n")})
    x, same = F.col(value).cast("double"), F.col("_n").cast("double")
    n, total = F.sum("_n"), F.sum(same * x)
    places = same * F.col("_below") + same * (same + 1) / 2
    raw = 2 * F.sum(places * x) / (n * total) - (n + 1) / n
    return ranked.groupBy(*group).agg(
        F.when((n < 2) | (total < 1e-12), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
        .alias("gini")
    )


def utilisation(gates: DataFrame) -> DataFrame:
    """Dead and monopoly flags per (task, expert) with the load imbalance of the task.

    Experts that are never first keep a line with share 0. A task has a handful of experts.
    """
    lines = gate_summary(gates).withColumn("top1_share", F.col("top1_share") * F.col("n") / (F.col("n") + F.lit(COUNT_EPS)))
    return lines.join(gini(lines.select("task", "expert", "top1_share"), ["task"], "top1_share"), "task").select(
        "task",
        "expert",
        "top1_share",
        F.col("gate_mean").alias("mean_weight"),
        (F.col("top1_share") < DEAD_SHARE).alias("is_dead"),
        (F.col("top1_share") > MONOPOLY_SHARE).alias("is_monopoly"),
        "gini",
        (F.col("gini") > IMBALANCE_GINI).alias("load_imbalance"),
    )


def expert_type(name: Column) -> Column:
    lower = F.lower(name)
    return (
        F.when(F.contains(lower, F.lit("mlp")), "mlp")
        .when(F.contains(lower, F.lit("cross")), "crossnet")
        .when(F.contains(lower, F.lit("identity")), "identity")
        .otherwise("other")
    )


def type_usage(named: DataFrame) -> DataFrame:
    """Mean top-1 share and weight per (task, expert type), from lines with an expert name."""
    return named.groupBy("task", expert_type(F.col("expert_name")).alias("expert_type")).agg(
        F.avg("top1_share").alias("avg_top1_share"),
        F.avg("mean_weight").alias("avg_mean_weight"),
        F.count(F.lit(1)).alias("expert_count"),
    )


def cross_task(named: DataFrame, first: str, second: str) -> DataFrame:
    """How differently two tasks use the experts they share (names marked ``[SHARE]``)."""
    share = lambda task: F.max(F.when(F.col("task") == task, F.col("top1_share")))
    return (
        named.where(F.contains("expert_name", F.lit("[SHARE]")))
        .groupBy("expert_name")
        .agg(share(first).alias("first_share"), share(second).alias("second_share"))
        .where("first_share IS NOT NULL AND second_share IS NOT NULL")
        .withColumn("specialization_score", F.abs(F.col("first_share") - F.col("second_share")))
    )


def output_stats(outputs: DataFrame) -> DataFrame:
    """Moments, sparsity and largest magnitude of each expert's outputs; ``outputs`` has (expert, v)."""
    v = F.col("v").cast("double")
    return outputs.groupBy("expert").agg(
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.avg((F.abs(v) < SPARSE_ABS).cast("double")).alias("sparsity"),
        F.max(F.abs(v)).alias("abs_max"),
    )


def output_similarity(rows: DataFrame, experts: Sequence[str]) -> DataFrame:
    """Cosine of the flattened outputs for each pair of experts; one array column per expert.

    The pairs are those of a configured handful of experts. Each row adds its dot products, so the
    whole is one aggregation without a join.
    """
    products = [(a, b) for i, a in enumerate(experts) for b in experts[i:]]
    sums = rows.agg(*[F.sum(dot(F.col(a), F.col(b))).alias(f"{a}|{b}") for a, b in products])
    norm = lambda a: F.sqrt(F.col(f"`{a}|{a}`")) + F.lit(COUNT_EPS)
    pairs = [
        F.struct(
            F.lit(a).alias("expert_i"),
            F.lit(b).alias("expert_j"),
            (F.col(f"`{a}|{b}`") / (norm(a) * norm(b))).alias("similarity"),
        )
        for a, b in products
        if a != b
    ]
    return sums.select(F.inline(F.array(*pairs))).withColumn("alert", F.col("similarity") > COLLAPSE_SIMILARITY)


def similarity_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.avg("similarity").alias("similarity_mean"),
        F.max("similarity").alias("similarity_max"),
        F.min("similarity").alias("similarity_min"),
        F.max("alert").alias("collapse_alert"),
    )


def ema(
    df: DataFrame, group: Sequence[str], order: Sequence[str], signal: str, alpha: float = EMA_ALPHA, out: str = "ema"
) -> DataFrame:
    """Final exponential moving average per group, started at the first value.

    The recursion unrolls to a weighted sum: the row i places before the end weighs a(1-a)^i, the
    first one (1-a)^(n-1). Ranks come from a distributed ordering, so a long group is no fold.
    """
    ranked = group_rank(df.where(F.col(signal).isNotNull()), group, order, "_i")
    size = ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    rows = lookup_join(ranked, size, group, "inner", spread_by=order)
    back = (F.col("_n") - 1 - F.col("_i")).cast("double")
    weight = F.pow(F.lit(1.0 - alpha), back) * F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    return rows.groupBy(*group).agg(F.sum(weight * F.col(signal).cast("double")).alias(out))


def conflict_summary(samples: DataFrame, group: Sequence[str], order: Sequence[str], alpha: float = EMA_ALPHA) -> DataFrame:
    """Gradient-conflict numbers per group from logged cosine samples.

    A sample counts when the second task has a gradient (``norm_2`` > 0). Columns: norm_1, norm_2,
    cos_all, and where logged cos_dense and cos_sparse, of the dense and the sparse shared weights
    alone (NULL allowed in all).
    """
    keys = list(group)
    has_second = F.coalesce(F.col("norm_2") > 0, F.lit(False))
    ratio = F.when(F.col("norm_1") > 0, F.col("norm_2") / F.col("norm_1"))
    counts = samples.groupBy(*keys).agg(
        F.count_if(has_second).alias("collected"), F.count_if(~has_second).alias("skipped_no_grad")
    )
    valid = samples.where(has_second).withColumn("ratio", ratio)
    valid = valid.withColumn("hit", F.when(F.col("cos_all").isNotNull(), (F.col("cos_all") < 0).cast("double")))
    base = valid.groupBy(*keys).agg(
        F.avg("norm_1").alias("norm_1_mean"),
        F.avg("norm_2").alias("norm_2_mean"),
        F.avg("ratio").alias("norm_ratio_mean"),
        F.avg("cos_all").alias("cosine_mean"),
        *[F.avg(f"cos_{p}").alias(f"cosine_{p}_mean") for p in ("dense", "sparse") if f"cos_{p}" in samples.columns],
        (F.coalesce(F.sum("hit"), F.lit(0.0)) / F.count(F.lit(1))).alias("conflict_rate"),
        F.avg(F.when(F.col("cos_all") < 0, F.col("cos_all"))).alias("neg_conflict_strength"),
    )
    parts = {f"cosine_{p}": f"cos_{p}" for p in ("dense", "sparse") if f"cos_{p}" in samples.columns}
    series = {"cosine": "cos_all", "norm_ratio": "ratio", **parts}
    lines = valid.select(*keys, F.inline(F.array(*[F.struct(F.lit(s).alias("_series"), F.col(c).cast("double").alias("_v")) for s, c in series.items()])))
    spread = value_quantiles(lines, [*keys, "_series"], "_v", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    pick = lambda s, p: F.max(F.when(F.col("_series") == s, F.col(p))).alias(f"{s}_{p}")
    quantiles = spread.groupBy(*keys).agg(*[pick(s, p) for s in series for p in ("p10", "p50", "p90") if (s, p) != ("norm_ratio", "p10")])
    smoothed = ema(valid, keys, order, "hit", alpha, "conflict_rate_ema")
    out = counts
    for part in (base, quantiles, smoothed):
        out = out.join(part, keys, "left")
    return out
