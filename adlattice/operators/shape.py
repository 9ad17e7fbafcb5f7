"""Bag lengths, truncation, hash collisions, value drift and the resulting feature advice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.functions.scalars import is_finite
from adlattice.operators.joins import lookup_join
from adlattice.operators.ordered import count_quantiles, counted_quantiles, cumulated
from adlattice.operators.tokens import FIELD_KEY
from adlattice.session import durable

# Fixed values.
MULTI_HOT_NNZ = 1.5
TRUNCATION_K = [10, 20, 30, 40, 60, 80, 120, 200]
BUCKETS = [8_192, 16_384, 32_768, 65_536, 131_072, 262_144, 524_288, 1_048_576, 2_097_152, 4_194_304]
# Fixed values: (least token share, collision limit offline, collision limit online).
COLLISION_BANDS = [(0.2, 0.02, 0.01), (0.05, 0.05, 0.02), (0.0, 0.10, 0.05)]
HEAVY_SHARE = 0.2
CAP_HEAVY = 60
CAP_LIGHT = 80
RETAINED_TOKENS = 0.995
RETAINED_ROWS = 0.95
PSI_FLOOR = 1e-6
DEFAULT_DIM = 16
DIM_CAP = 8
DEFAULT_POOLING = "sum_sqrtn"
WEIGHTED_POOLING = "weighted_sum_sqrtn"

LENGTH_PROBS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
VALUE_PROBS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def multi_hot_fields(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("avg_nnz_per_covered_row") > MULTI_HOT_NNZ).select(*FIELD_KEY)


def informative_fields(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("val_non1_ratio") > 0).select(*FIELD_KEY)


def bag_lengths(tokens: DataFrame, fields: DataFrame) -> DataFrame:
    """Tokens per (row, field, src) of the given fields."""
    wanted = lookup_join(tokens.select("row_id", *FIELD_KEY), fields, FIELD_KEY, "left_semi")
    return wanted.groupBy(*FIELD_KEY, "row_id").agg(F.count(F.lit(1)).alias("l"))


def length_quantiles(lengths: DataFrame, n_rows: DataFrame) -> DataFrame:
    base = lengths.groupBy(*FIELD_KEY).agg(
        F.count(F.lit(1)).alias("covered_rows"), F.avg(F.col("l").cast("double")).alias("mean_len")
    )
    return base.join(count_quantiles(lengths, FIELD_KEY, "l", LENGTH_PROBS), FIELD_KEY).select(
        *FIELD_KEY,
        "covered_rows",
        (F.col("covered_rows") / n_rows.scalar()).alias("coverage_rate"),
        "mean_len",
        *LENGTH_PROBS,
    )


def truncation_curve(lengths: DataFrame, ks: list[int] = TRUNCATION_K) -> DataFrame:
    """What a bag limit K keeps. Candidates meet the length histogram, not the rows."""
    hist = lengths.groupBy(*FIELD_KEY, "l").agg(F.count(F.lit(1)).alias("n"))
    at = hist.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return at.groupBy(*FIELD_KEY, "k").agg(
        (F.sum(F.least("l", "k") * F.col("n")) / F.sum(F.col("l") * F.col("n"))).alias("retained_token_frac"),
        (F.sum(F.when(F.col("l") <= F.col("k"), F.col("n")).otherwise(0)) / F.sum("n")).alias("retained_row_full_frac"),
    )


def token_share(stats: DataFrame) -> DataFrame:
    """Share of all tokens per field; without token counts, of coverage times bag size."""
    if "token_rows" in stats.columns:
        volume = F.col("token_rows").cast("double")
    else:
        volume = F.col("coverage_rate") * F.col("avg_nnz_per_covered_row")
    total = stats.agg(F.sum(volume).alias("v"))
    return stats.withColumn("token_share", F.coalesce(F.try_divide(volume, total.scalar()), F.lit(0.0)))


def collision_curve(stats: DataFrame, buckets: list[int] = BUCKETS) -> DataFrame:
    """Expected occupied buckets and collisions of n distinct fids thrown into m buckets."""
    n, m = F.col("fid_distinct").cast("double"), F.col("bucket").cast("double")
    return (
        stats.select(*FIELD_KEY, "fid_distinct")
        .withColumn("bucket", F.explode(F.array(*[F.lit(b).cast("long") for b in buckets])))
        .withColumn("expected_occupied", m * (F.lit(1.0) - F.exp(-n / m)))
        .withColumn("expected_collision", F.greatest(F.lit(0.0), n - F.col("expected_occupied")))
        .withColumn("collision_rate", F.coalesce(F.try_divide(F.col("expected_collision"), n), F.lit(0.0)))
    )


def bucket_advice(shares: DataFrame, curve: DataFrame) -> DataFrame:
    """Smallest bucket count under the collision limit of the field's token-share band."""
    limits = {}
    for i, name in ((1, "threshold_local"), (2, "threshold_online")):
        level = F.lit(COLLISION_BANDS[-1][i])
        for band in reversed(COLLISION_BANDS[:-1]):
            level = F.when(F.col("token_share") >= band[0], F.lit(band[i])).otherwise(level)
        limits[name] = level
    rows = curve.join(shares.select(*FIELD_KEY, "token_share"), FIELD_KEY).withColumns(limits)
    first = lambda limit: F.coalesce(
        F.min(F.when(F.col("collision_rate") < F.col(limit), F.col("bucket"))), F.max("bucket")
    )
    return rows.groupBy(*FIELD_KEY, "fid_distinct", "token_share", *limits).agg(
        first("threshold_local").alias("bucket_local"), first("threshold_online").alias("bucket_online")
    )


def value_cube(tokens: DataFrame, train: str = "train", valid: str = "valid") -> DataFrame:
    """(field, src, val) with the number of tokens on both sides (a, b), of smaller finite ones (below_a, below_b) and of all finite
    ones (total_a, total_b).

    ``tokens`` carry their split. They are read once and collapse to one row per value before any of them move; edges, bins,
    drift and profiles follow from this table.
    """
    side = lambda s: F.count_if(F.col("split") == s)
    val = F.col("val").cast("double").alias("val")
    counts = tokens.where(F.col("split").isin(train, valid)).groupBy(*FIELD_KEY, val).agg(side(train).alias("a"), side(valid).alias("b"))
    finite = lambda c: F.when(is_finite(F.col("val")), F.col(c)).otherwise(0)
    kept = durable(counts).withColumns({"_fa": finite("a"), "_fb": finite("b")})
    return durable(cumulated(kept, FIELD_KEY, "val", {"a": "_fa", "b": "_fb"}).drop("_fa", "_fb"))


def both_sides(train: DataFrame, valid: DataFrame) -> DataFrame:
    part = lambda df, s: df.select(*FIELD_KEY, "val", F.lit(s).alias("split"))
    return part(train, "train").unionByName(part(valid, "valid"))


def cube_fields(cube: DataFrame) -> DataFrame:
    """Fields with a value other than 1 on the training side."""
    return cube.where((F.col("val") != 1.0) & (F.col("a") > 0)).select(*FIELD_KEY).distinct()


def _quantiles(cube: DataFrame, side: str, probs: dict[str, float]) -> DataFrame:
    return counted_quantiles(cube.where(is_finite(F.col("val"))), FIELD_KEY, "val", probs, side, f"below_{side}", f"total_{side}")


def cube_edges(cube: DataFrame, fields: DataFrame) -> DataFrame:
    """Distinct inner deciles of the finite training values per field, ascending."""
    probs = {f"d{i}": i / 10 for i in range(1, 10)}
    q = _quantiles(lookup_join(cube, fields, FIELD_KEY, "left_semi"), "a", probs)
    return q.select(*FIELD_KEY, F.array_sort(F.array_distinct(F.array(*probs))).alias("edges"))


def cube_histogram(cube: DataFrame, edges: DataFrame) -> DataFrame:
    """Fractions of both sides per value bin; a bin ends before its edge, the last one is open."""
    position = F.size(F.filter("edges", lambda e: e <= F.col("val")))
    counts = (
        lookup_join(cube.where(is_finite(F.col("val"))), edges, FIELD_KEY, "inner")
        .groupBy(*FIELD_KEY, position.alias("bin"))
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    totals = cube.groupBy(*FIELD_KEY).agg(F.max("total_a").alias("na"), F.max("total_b").alias("nb"))
    bins = edges.select(*FIELD_KEY, F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    part = lambda c, n: F.coalesce(F.try_divide(F.coalesce(c, F.lit(0)), F.col(n)), F.lit(0.0))
    return (
        bins.join(counts, [*FIELD_KEY, "bin"], "left")
        .join(totals, FIELD_KEY, "left")
        .select(*FIELD_KEY, "bin", part("a", "na").alias("train_frac"), part("b", "nb").alias("valid_frac"))
    )


def psi(histogram: DataFrame) -> DataFrame:
    """Population stability index per field, fractions floored at 1e-6."""
    p = F.greatest("train_frac", F.lit(PSI_FLOOR))
    q = F.greatest("valid_frac", F.lit(PSI_FLOOR))
    return histogram.groupBy(*FIELD_KEY).agg(F.sum((p - q) * F.log(p / q)).alias("psi"))


def cube_profile(cube: DataFrame, fields: DataFrame) -> DataFrame:
    """Special-value ratios and quantiles of both sides, side by side; null for a side without the field."""
    wanted = lookup_join(cube, fields, FIELD_KEY, "left_semi")
    val = F.col("val")
    special = {"zero": val == 0, "neg": val < 0, "nan": F.isnan("val"), "inf": F.abs("val") == float("inf")}
    measures, quantiles = [], None
    for name, c in (("train", "a"), ("valid", "b")):
        total = F.sum(c)
        measures.append(F.when(total > 0, total).alias(f"{name}_total"))
        measures += [F.try_divide(F.sum(F.when(cond, F.col(c)).otherwise(0)), total).alias(f"{name}_{k}_ratio") for k, cond in special.items()]
        measures.append(F.max(F.when(is_finite(val) & (F.col(c) > 0), val)).alias(f"{name}_max"))
        own = _quantiles(wanted, c, VALUE_PROBS).select(*FIELD_KEY, *[F.col(p).alias(f"{name}_{p}") for p in VALUE_PROBS])
        quantiles = own if quantiles is None else quantiles.join(own, FIELD_KEY, "full_outer")
    return wanted.groupBy(*FIELD_KEY).agg(*measures).join(quantiles, FIELD_KEY, "left")


def decile_edges(tokens: DataFrame, fields: DataFrame) -> DataFrame:
    """``cube_edges`` of one side's tokens."""
    return cube_edges(value_cube(tokens.withColumn("split", F.lit("train"))), fields)


def value_histogram(train: DataFrame, valid: DataFrame, edges: DataFrame) -> DataFrame:
    """``cube_histogram`` of the tokens of both sides."""
    return cube_histogram(value_cube(both_sides(train, valid)), edges)


def value_profile(train: DataFrame, valid: DataFrame, fields: DataFrame) -> DataFrame:
    """``cube_profile`` of the tokens of both sides."""
    return cube_profile(value_cube(both_sides(train, valid)), fields)


def max_len_advice(shares: DataFrame, curve: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Smallest K under the cap that keeps nearly all tokens; else the best K; else the p99 length."""
    cap = F.when(F.col("token_share") >= HEAVY_SHARE, F.lit(CAP_HEAVY)).otherwise(F.lit(CAP_LIGHT))
    rows = (
        shares.select(*FIELD_KEY, cap.alias("cap"))
        .join(curve, FIELD_KEY)
        .join(quantiles.select(*FIELD_KEY, "p99"), FIELD_KEY, "left")
    )
    under = F.col("k") <= F.col("cap")
    good = under & (F.col("retained_token_frac") >= RETAINED_TOKENS) & (F.col("retained_row_full_frac") >= RETAINED_ROWS)
    quality = F.struct("retained_token_frac", "retained_row_full_frac", -F.col("k"))
    return rows.groupBy(*FIELD_KEY).agg(
        F.coalesce(
            F.min(F.when(good, F.col("k"))),
            F.max_by(F.when(under, F.col("k")), F.when(under, quality)),
            F.max(F.when(F.col("p99").isNotNull(), F.least(F.col("cap"), F.ceil("p99")))),
        )
        .cast("long")
        .alias("max_len")
    )


def top_fields(shares: DataFrame, n: int) -> DataFrame:
    return shares.orderBy(F.desc("token_share"), *FIELD_KEY).limit(n).select(*FIELD_KEY, "token_share")


def feature_advice(
    stats: DataFrame, encodings: DataFrame, buckets: DataFrame, lengths: DataFrame, existing: DataFrame
) -> DataFrame:
    """One recommended feature per (field, src). All inputs have one line per field.

    ``existing`` is the table of the current feature map; fields it lacks get the defaults.
    """
    shares = token_share(stats)
    heavy = top_fields(shares, 3).select(*FIELD_KEY, F.lit(True).alias("heavy"))
    current = existing.select(
        *FIELD_KEY,
        F.col("multi_hot").alias("old_multi"),
        F.col("use_value").alias("old_value"),
        F.col("max_len").alias("old_len"),
        F.col("pooling").alias("old_pooling"),
        F.col("embedding_dim").alias("old_dim"),
        F.col("encoding").alias("old_encoding"),
    )
    cap = F.when(F.col("token_share") >= HEAVY_SHARE, F.lit(CAP_HEAVY)).otherwise(F.lit(CAP_LIGHT))
    wants_bag = F.coalesce("old_multi", F.lit(False)) | (F.col("avg_nnz_per_covered_row") > MULTI_HOT_NNZ)
    pooling = F.coalesce("old_pooling", F.lit(DEFAULT_POOLING))
    dim = F.coalesce("old_dim", F.lit(DEFAULT_DIM))
    return (
        shares.join(encodings, FIELD_KEY, "left")
        .join(buckets.select(*FIELD_KEY, "bucket_local"), FIELD_KEY, "left")
        .join(lengths, FIELD_KEY, "left")
        .join(current, FIELD_KEY, "left")
        .join(heavy, FIELD_KEY, "left")
        .withColumn("encoding", F.coalesce("recommended_encoding", "old_encoding", F.lit("hash")))
        .withColumn("_len", F.when(wants_bag, F.coalesce("max_len", F.when(F.col("old_len").isNotNull(), F.least(cap, F.col("old_len"))))))
        .withColumn("_multi", F.col("_len").isNotNull())
        .withColumn("_value", F.coalesce("old_value", F.col("val_non1_ratio") > 0))
        .select(
            *FIELD_KEY,
            "encoding",
            F.when(F.col("heavy"), F.least(dim, F.lit(DIM_CAP))).otherwise(dim).cast("int").alias("embedding_dim"),
            F.col("_multi").alias("is_multi_hot"),
            F.col("_len").cast("long").alias("max_len"),
            F.col("_value").alias("use_value"),
            F.when(F.col("_multi") & F.col("_value") & ~F.contains(pooling, F.lit("weighted")), F.lit(WEIGHTED_POOLING))
            .otherwise(pooling)
            .alias("pooling"),
            F.when(F.col("encoding") != "hash", F.col("recommended_head_size")).alias("vocab_num_tokens"),
            F.when(F.col("encoding") != "vocab", F.col("bucket_local")).alias("hash_bucket"),
        )
    )
