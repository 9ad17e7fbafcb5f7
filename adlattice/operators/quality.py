"""Funnel rules and checks of the encoded table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlattice.operators.encode import column_names
from adlattice.spec import OOV_ID, Feature, FeatureMap

# Fixed values.
MAX_OOV_RATE = 0.95
ONE_TOLERANCE = 1e-6
MANDATORY = ["y_ctr", "y_cvr", "y_ctcvr", "click_mask", "row_id", "entity_id"]


def _broken() -> Column:
    return (F.col("y_ctr") <= 0) & (F.col("y_cvr") > 0)


def coerce_funnel(rows: DataFrame) -> DataFrame:
    """Conversions without a click are set to 0 and marked; the joint label follows."""
    y_cvr = F.when(F.col("y_ctr") <= 0, F.lit(0)).otherwise(F.col("y_cvr"))
    mask = F.coalesce(F.col("click_mask"), (F.col("y_ctr") > 0).cast("byte")) if "click_mask" in rows.columns else (
        F.col("y_ctr") > 0
    ).cast("byte")
    return (
        rows.withColumn("funnel_bad", _broken())
        .withColumn("click_mask", mask)
        .withColumn("y_cvr", y_cvr.cast("byte"))
        .withColumn("y_ctcvr", ((F.col("y_ctr") > 0.5) & (F.col("y_cvr") > 0.5)).cast("byte"))
    )


def drop_broken_funnel(rows: DataFrame) -> DataFrame:
    """Rows whose labels form a valid funnel."""
    return rows.where(~_broken())


def require_rows(rows: DataFrame) -> DataFrame:
    if rows.isEmpty():
        raise ValueError("no row is left after the funnel filter")
    return rows


def missing_columns(processed: DataFrame, features: FeatureMap) -> DataFrame:
    """Issue lines for columns the feature map asks for; value columns only where values are used."""
    have = set(processed.columns)
    absent = [c for c in [*MANDATORY, *column_names(features)] if c not in have]
    return processed.sparkSession.createDataFrame([(c, "missing column") for c in absent], "name string, issue string")


def _ids(f: Feature) -> Column:
    col = F.col(f"{f.name}_idx")
    return col if f.multi_hot else F.array(col)


def _vals(f: Feature) -> Column:
    col = F.col(f"{f.name}_val")
    return col if f.multi_hot else F.array(col)


def feature_report(processed: DataFrame, features: FeatureMap) -> DataFrame:
    """Ids, unseen ids, non-one values and largest id per feature: one scan, one aggregation.

    Arrays are reduced inside the row before anything is summed.
    """
    present = [f for f in features if f"{f.name}_idx" in processed.columns]
    stats = []
    for f in present:
        ids = _ids(f)
        has_val = f.use_value and f"{f.name}_val" in processed.columns
        non_one = F.size(F.filter(_vals(f), lambda v: F.abs(v.cast("double") - 1.0) > ONE_TOLERANCE)) if has_val else None
        stats.append(
            F.struct(
                F.lit(f.name).alias("name"),
                F.lit(f.has_vocab).alias("has_vocab"),
                F.lit(f.use_value).alias("use_value"),
                F.lit(f.total_rows).cast("long").alias("total_rows"),
                F.sum(F.size(ids)).alias("ids"),
                F.sum(F.size(F.filter(ids, lambda i: i == OOV_ID))).alias("oov_ids"),
                (F.sum(non_one) if has_val else F.lit(None).cast("long")).alias("non_one"),
                F.max(F.array_max(ids)).alias("max_idx"),
            )
        )
    return processed.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def oov_check(report: DataFrame) -> DataFrame:
    """Share of unseen ids of the features with a vocabulary head; above .95 fails."""
    rate = F.col("oov_ids") / F.greatest("ids", F.lit(1))
    return report.where("has_vocab").select("name", rate.alias("oov_rate"), (rate > MAX_OOV_RATE).alias("failed"))


def value_check(report: DataFrame) -> DataFrame:
    """A feature that uses values must have some that differ from 1."""
    return report.where("use_value").select(
        "name", "ids", "non_one", ((F.col("ids") > 0) & (F.col("non_one") == 0)).alias("failed")
    )


def overflow_check(report: DataFrame) -> DataFrame:
    return report.select("name", "max_idx", "total_rows", (F.col("max_idx") >= F.col("total_rows")).alias("failed"))


def row_reconciliation(processed: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows of both tables and whether they agree."""
    n = samples.agg(F.count(F.lit(1)).alias("n"))
    return processed.agg(F.count(F.lit(1)).alias("processed_rows")).select(
        "processed_rows",
        n.scalar().alias("samples_rows"),
        (F.col("processed_rows") == n.scalar()).alias("matches"),
    )


def require_same_rows(processed: DataFrame, samples: DataFrame) -> None:
    line = row_reconciliation(processed, samples).first()
    if not line["matches"]:
        raise ValueError(f"{line['processed_rows']} processed rows for {line['samples_rows']} samples")


def contract_check(processed: DataFrame) -> DataFrame:
    """Mandatory columns, label domain and row id uniqueness, one line per rule."""
    absent = [c for c in MANDATORY if c not in processed.columns]
    labels = [c for c in MANDATORY[:4] if c not in absent]
    off_domain = [F.count_if(~F.coalesce(F.col(c).isin(0, 1), F.lit(False))).alias(c) for c in labels]
    domain = processed.agg(*off_domain).select(
        F.inline(F.array(*[F.struct(F.concat(F.lit(c), F.lit(" in {0,1}")).alias("rule"), F.col(c).alias("violations")) for c in labels]))
    )
    twins = processed.groupBy("row_id").agg((F.count(F.lit(1)) - 1).alias("extra"))
    unique = twins.agg(F.lit("row_id unique").alias("rule"), F.coalesce(F.sum("extra"), F.lit(0)).alias("violations"))
    schema = processed.sparkSession.createDataFrame([("columns present", len(absent))], "rule string, violations long")
    return schema.unionByName(domain).unionByName(unique).withColumn("passed", F.col("violations") == 0)
