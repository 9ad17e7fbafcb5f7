"""Training metrics logs: one JSON record per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRIC_COLUMNS = (
    "auc_ctr", "auc_cvr", "auc_cvr_masked", "auc_ctcvr", "auc_primary",
    "loss", "loss_ctr", "loss_cvr", "loss_ctcvr",
)
LOG_SCHEMA = (
    "run_id string, split string, epoch long, global_step long, should_update boolean, "
    + ", ".join(f"{c} double" for c in METRIC_COLUMNS)
)


def read_metrics_log(spark: SparkSession, path: str) -> DataFrame:
    """All readable records; blank lines and lines that are not JSON are left out.

    ``position`` is the record's place in its file; in the order of files where there are several.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    record = F.from_json("value", f"{LOG_SCHEMA}, _bad string", options)
    lines = spark.read.text(path).where(F.trim("value") != "")
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return lines.select(record.alias("r"), position.alias("position")).where("r._bad IS NULL").select("r.*", "position").drop("_bad")


def valid_records(log: DataFrame) -> DataFrame:
    return log.where("split = 'valid'")


def decision_records(log: DataFrame) -> DataFrame:
    return log.where("split = 'valid_decision'")
