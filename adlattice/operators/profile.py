"""Profiles of samples and tokens: frequencies, coverage, top-k, lift, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adlattice.functions.scalars import bin_index
from adlattice.operators.joins import lookup_join
from adlattice.operators.ordered import count_quantiles
from adlattice.operators.split import label_rates
from adlattice.operators.tokens import FIELD_KEY, token_counts
from adlattice.session import lies_by, partitions_for

# Left edges of the tokens-per-row histogram.
NNZ_EDGES = [0, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000]
#: Groups of fids whose best meet in one task.
FAN_IN = 64
QUARTET = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def samples_profile(samples: DataFrame) -> DataFrame:
    return samples.agg(*label_rates(), F.count_distinct("entity_id").alias("unique_entity"))


def entity_frequency(samples: DataFrame) -> DataFrame:
    """Rows per entity and their share of all rows."""
    total = samples.agg(F.count(F.lit(1)).alias("n"))
    counts = samples.groupBy("entity_id").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.withColumn("coverage", F.col("cnt") / total.scalar())


def entity_frequency_quantiles(samples: DataFrame) -> DataFrame:
    counts = samples.groupBy("entity_id").agg(F.count(F.lit(1)).alias("cnt"))
    return count_quantiles(counts, [], "cnt", QUARTET)


def top_share_coverage(samples: DataFrame, share: float = 0.01) -> DataFrame:
    """Share of rows owned by the most frequent ``share`` of entities (at least one).

    Works on the histogram of frequencies: at most sqrt(2 * rows) lines, whatever the entity count.
    """
    counts = samples.groupBy("entity_id").agg(F.count(F.lit(1)).alias("cnt"))
    hist = counts.groupBy("cnt").agg(F.count(F.lit(1)).alias("entities"))
    totals = hist.agg(
        F.struct(
            F.greatest(F.ceil(F.sum("entities") * F.lit(share)), F.lit(1)).alias("top"),
            F.sum("entities").alias("entities"),
            F.sum(F.col("cnt") * F.col("entities")).alias("rows"),
        ).alias("t")
    )
    above = Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    return (
        hist.withColumn("_t", totals.scalar())
        .withColumn("_above", F.coalesce(F.sum("entities").over(above), F.lit(0)))
        .withColumn("_take", F.greatest(F.least(F.col("entities"), F.col("_t.top") - F.col("_above")), F.lit(0)))
        .agg(
            F.max("_t.entities").alias("unique_entity"),
            F.max("_t.top").alias("top_entities"),
            (F.sum(F.col("_take") * F.col("cnt")) / F.max("_t.rows")).alias("top_coverage"),
        )
    )


def row_lengths(tokens: DataFrame) -> DataFrame:
    """Tokens per row over all files."""
    return tokens.groupBy("row_id").agg(F.count(F.lit(1)).alias("nnz"))


def row_length_quantiles(tokens: DataFrame) -> DataFrame:
    return count_quantiles(row_lengths(tokens), [], "nnz", QUARTET)


def row_length_histogram(tokens: DataFrame, edges: list[int] = NNZ_EDGES) -> DataFrame:
    """Rows per left-closed length bin; the last bin is open and empty bins are kept."""
    spark = tokens.sparkSession
    rights: list[float | None] = [*map(float, edges[1:]), None]
    bins = spark.createDataFrame(
        [(i, float(left), right) for i, (left, right) in enumerate(zip(edges, rights))],
        "bin int, bin_left double, bin_right double",
    )
    counted = (
        row_lengths(tokens)
        .groupBy(bin_index(F.col("nnz").cast("double"), edges).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = counted.agg(F.sum("n").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return bins.join(counted, "bin", "left").select(
        "bin_left",
        "bin_right",
        n.alias("count_rows"),
        F.coalesce(F.try_divide(n, total.scalar()), F.lit(0.0)).alias("ratio_rows"),
    )


def field_stats(tokens: DataFrame, n_samples: DataFrame, exact: bool = True) -> DataFrame:
    """Per (field, src): volume, coverage, bag size, distinct fids, value range, duplicate rate.

    ``n_samples`` is a one-row frame. Exact mode lays the tokens out by (field, src, row_id) once, or
    leaves them where they lie by row_id, so that row coverage and duplicates need no further shuffle; distinct
    fids come from the pre-aggregated counts. ``exact=False`` takes sketches in a single aggregation.
    """
    val = F.col("val").cast("double")
    if exact:
        cells = (
            (tokens if lies_by(tokens, ["row_id"]) else tokens.repartition("field", "src", "row_id"))
            .groupBy("field", "src", "row_id", "fid")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.count_if(val != 1.0).alias("non1"),
                F.min(val).alias("lo"),
                F.max(val).alias("hi"),
                F.sum(val).alias("total"),
            )
        )
        rows = cells.groupBy("field", "src", "row_id").agg(
            F.sum("n").alias("n"),
            F.sum("non1").alias("non1"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.sum("total").alias("total"),
            F.count(F.lit(1)).alias("cells"),
        )
        agg = rows.groupBy(*FIELD_KEY).agg(
            F.sum("n").alias("token_rows"),
            F.count(F.lit(1)).alias("row_coverage"),
            F.sum("non1").alias("non1"),
            F.min("lo").alias("val_min"),
            F.max("hi").alias("val_max"),
            F.sum("total").alias("total"),
            F.sum("cells").alias("cells"),
        )
        fids = token_counts(tokens).groupBy(*FIELD_KEY).agg(F.count(F.lit(1)).alias("fid_distinct"))
        agg = agg.join(fids, FIELD_KEY)
    else:
        agg = tokens.groupBy(*FIELD_KEY).agg(
            F.count(F.lit(1)).alias("token_rows"),
            F.approx_count_distinct("row_id", 0.01).alias("row_coverage"),
            F.count_if(val != 1.0).alias("non1"),
            F.min(val).alias("val_min"),
            F.max(val).alias("val_max"),
            F.sum(val).alias("total"),
            F.approx_count_distinct(F.struct("row_id", "fid"), 0.01).alias("cells"),
            F.approx_count_distinct("fid", 0.01).alias("fid_distinct"),
        )
    return agg.select(
        *FIELD_KEY,
        "token_rows",
        "row_coverage",
        (F.col("row_coverage") / n_samples.scalar()).alias("coverage_rate"),
        (F.col("token_rows") / F.col("row_coverage")).alias("avg_nnz_per_covered_row"),
        "fid_distinct",
        (F.col("non1") / F.col("token_rows")).alias("val_non1_ratio"),
        "val_min",
        "val_max",
        (F.col("total") / F.col("token_rows")).alias("val_mean"),
        (1 - F.col("cells") / F.col("token_rows")).alias("dup_rate"),
    )


def field_top_k(counts: DataFrame, k: int, fan: int = FAN_IN) -> DataFrame:
    """The ``k`` most frequent fids per (field, src), ties by fid.

    The rank filter is pushed below the shuffle, so a group sends at most k rows per partition. Where there are more than ``fan``
    partitions, a field's fids are first dealt into groups by their hash, and the best of ``fan`` groups meet
    in the next: no task but those of the first groups gets more than ``fan`` times k rows of a field.
    """
    totals = counts.groupBy(*FIELD_KEY).agg(F.sum("cnt").alias("token_rows"))
    parts = partitions_for(counts) or int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups, best = 1, counts.withColumn("_draw", F.pmod(F.xxhash64("fid"), F.lit(1 << 30)))
    while groups * fan < parts:
        groups *= fan
    while groups > 1:
        best = _best_of(best, [*FIELD_KEY, F.pmod("_draw", F.lit(groups))], k).drop("rn")
        groups //= fan
    return _best_of(best, FIELD_KEY, k).drop("_draw").join(totals, FIELD_KEY).select(
        *FIELD_KEY, "fid", "cnt", "rn", (F.col("cnt") / F.col("token_rows")).alias("topk_coverage")
    )


def _best_of(counts: DataFrame, keys: list, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("cnt"), "fid")
    return counts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def labelled_top_tokens(tokens: DataFrame, top: DataFrame, samples: DataFrame) -> DataFrame:
    """Distinct (row_id, field, src, fid) of the top fids with the labels of the row."""
    keys = top.select(*FIELD_KEY, "fid")
    hits = lookup_join(tokens.select("row_id", *FIELD_KEY, "fid"), keys, [*FIELD_KEY, "fid"], "inner")
    labels = samples.select("row_id", "y1", "y2")
    return hits.join(labels, "row_id").dropDuplicates(["row_id", *FIELD_KEY, "fid"])


def fid_lift(labelled: DataFrame, samples: DataFrame, min_support: int) -> DataFrame:
    """Label rates of rows with a fid over the overall rates; 0 where the overall rate is 0."""
    overall = samples.agg(F.struct(F.avg("y1").alias("ctr"), F.avg("y2").alias("cvr")).alias("o"))
    return (
        labelled.groupBy(*FIELD_KEY, "fid")
        .agg(F.count(F.lit(1)).alias("cnt_rows"), F.avg("y1").alias("ctr_fid"), F.avg("y2").alias("cvr_fid"))
        .where(F.col("cnt_rows") >= min_support)
        .withColumn("_o", overall.scalar())
        .withColumn("lift_ctr", F.coalesce(F.try_divide("ctr_fid", F.col("_o.ctr")), F.lit(0.0)))
        .withColumn("lift_cvr", F.coalesce(F.try_divide("cvr_fid", F.col("_o.cvr")), F.lit(0.0)))
        .drop("_o")
    )


def row_coverage(tokens: DataFrame) -> DataFrame:
    """Distinct rows per (field, src)."""
    return (
        tokens.groupBy(*FIELD_KEY, "row_id").agg(F.lit(1).alias("one"))
        .groupBy(*FIELD_KEY).agg(F.count(F.lit(1)).alias("row_coverage"))
    )


def coverage_drift(train: DataFrame, valid: DataFrame, n_train: DataFrame, n_valid: DataFrame) -> DataFrame:
    """Coverage of both sides per (field, src); a field missing on one side counts 0 there."""
    a = row_coverage(train).withColumnRenamed("row_coverage", "ct")
    b = row_coverage(valid).withColumnRenamed("row_coverage", "cv")
    rate = lambda c, n: F.coalesce(F.try_divide(F.coalesce(c, F.lit(0)), n.scalar()), F.lit(0.0))
    return (
        a.join(b, FIELD_KEY, "full_outer")
        .select(*FIELD_KEY, rate("ct", n_train).alias("coverage_train"), rate("cv", n_valid).alias("coverage_valid"))
        .withColumn("coverage_diff", F.col("coverage_train") - F.col("coverage_valid"))
    )


def key_sets(train_top: DataFrame, valid_top: DataFrame) -> DataFrame:
    """Size of union and intersection of two top-fid sets per (field, src)."""
    a = train_top.select(*FIELD_KEY, "fid", F.lit(1).alias("a"))
    b = valid_top.select(*FIELD_KEY, "fid", F.lit(1).alias("b"))
    return (
        a.join(b, [*FIELD_KEY, "fid"], "full_outer")
        .groupBy(*FIELD_KEY)
        .agg(
            F.count(F.lit(1)).alias("union_size"),
            F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("inter_size"),
        )
    )


def top_jaccard(train_top: DataFrame, valid_top: DataFrame) -> DataFrame:
    """Jaccard similarity of the top sets; two empty sets count as equal."""
    return key_sets(train_top, valid_top).select(
        *FIELD_KEY, F.coalesce(F.try_divide("inter_size", "union_size"), F.lit(1.0)).alias("topk_jaccard")
    )


def drift_summary(coverage: DataFrame, jaccard: DataFrame) -> DataFrame:
    return coverage.join(jaccard, FIELD_KEY, "full_outer").select(
        *FIELD_KEY,
        F.coalesce("coverage_train", F.lit(0.0)).alias("coverage_train"),
        F.coalesce("coverage_valid", F.lit(0.0)).alias("coverage_valid"),
        F.coalesce("coverage_diff", F.lit(0.0)).alias("coverage_diff"),
        F.coalesce("topk_jaccard", F.lit(1.0)).alias("topk_jaccard"),
    )


def largest_gaps(drift: DataFrame, n: int = 20) -> DataFrame:
    return drift.orderBy(F.desc(F.abs("coverage_diff")), *FIELD_KEY).limit(n)


def lowest_overlap(drift: DataFrame, n: int = 20) -> DataFrame:
    return drift.orderBy("topk_jaccard", *FIELD_KEY).limit(n)


def sanity_report(samples: DataFrame, tokens: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row that sets declared token rows against scanned ones, with rates and leak check per split.

    ``samples`` carry a split; ``tokens`` is the whole table and ``assigned`` the split one.
    """
    train, valid = (samples.where(F.col("split") == s) for s in ("train", "valid"))
    overlap = (
        samples.groupBy("entity_id").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n"))
    )
    expected = tokens.agg(F.count(F.lit(1)).alias("n"))
    scanned = assigned.agg(
        F.struct(
            F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "valid").alias("valid")
        ).alias("s")
    )
    rates = lambda df: df.agg(F.struct(*label_rates()).alias("r")).scalar()
    one = samples.sparkSession.range(1).select(
        rates(train).alias("t"), rates(valid).alias("v"), scanned.scalar().alias("s"),
        expected.scalar().alias("expected_total"), overlap.scalar().alias("entity_overlap_count"),
    )
    return one.select(
        F.col("t.rows").alias("n_train_samples"),
        F.col("v.rows").alias("n_valid_samples"),
        F.col("t.ctr").alias("train_ctr"),
        F.col("v.ctr").alias("valid_ctr"),
        F.col("t.cvr").alias("train_cvr"),
        F.col("v.cvr").alias("valid_cvr"),
        F.col("t.funnel_anomaly").alias("funnel_bad_train"),
        F.col("v.funnel_anomaly").alias("funnel_bad_valid"),
        "entity_overlap_count",
        F.col("s.train").alias("tokens_train_rows"),
        F.col("s.valid").alias("tokens_valid_rows"),
        "expected_total",
        (F.col("s.train") + F.col("s.valid") - F.col("expected_total")).alias("tokens_diff"),
    )
