"""Parquet layouts, manifests and small report files."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlattice.session import ROW_INPUT, colocated, partitions_for, parts_of, read_colocated

SAMPLE_COLUMNS = {
    "row_id": "long",
    "y1": "tinyint",
    "y2": "tinyint",
    "entity_id": "string",
    "c4": "int",
    "c0": "long",
}
TOKEN_COLUMNS = {"row_id": "long", "src": "tinyint", "field": "string", "fid": "string", "val": "float"}


def _typed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in columns.items()])


def save_mode(overwrite: bool) -> str:
    """Existing output is kept unless ``overwrite`` is set."""
    return "overwrite" if overwrite else "ignore"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_samples(samples: DataFrame, path: str, overwrite: bool = False) -> None:
    _typed(samples, SAMPLE_COLUMNS).write.mode(save_mode(overwrite)).parquet(path)


def fitting_parts(df: DataFrame, parts: int) -> int:
    """``parts``, or more where a part would be more than one task sorts and writes."""
    return max(parts, parts_of(df, ROW_INPUT))


def write_tokens(
    tokens: DataFrame,
    path: str,
    max_rows_per_file: int = 3_000_000,
    parts: int | None = None,
    overwrite: bool = False,
) -> None:
    """Token files that each cover one row_id range, so a row range prunes files and row groups.

    ``parts`` is the least number of ranges; larger tables get as many as their bytes need.
    """
    typed = _typed(tokens, TOKEN_COLUMNS)
    parts = fitting_parts(typed, parts) if parts else partitions_for(typed, ROW_INPUT)
    ranged = typed.repartitionByRange(parts, "row_id") if parts else typed.repartitionByRange("row_id")
    (
        ranged.sortWithinPartitions("row_id", "src", "field")
        .write.option("maxRecordsPerFile", max_rows_per_file)
        .mode(save_mode(overwrite))
        .parquet(path)
    )


def part_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per file: row_id range and rows, in row_id order."""
    return (
        spark.read.parquet(path)
        .groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(
            F.min("row_id").alias("row_id_min"),
            F.max("row_id").alias("row_id_max"),
            F.count(F.lit(1)).alias("token_rows"),
        )
        .orderBy("row_id_min", "file")
    )


def compact_tokens(
    spark: SparkSession,
    source: str,
    target: str,
    target_parts: int | None = None,
    max_rows_per_file: int | None = None,
) -> DataFrame:
    """Rewrite many small token files as about ``target_parts`` large ones; returns the manifest.

    Where these would be larger than one task writes there are more of them (``fitting_parts``).
    The new files go to a new path. Row counts are compared before the manifest is handed out.
    """
    before = spark.read.parquet(source).count()
    if before <= 0:
        raise ValueError(f"no token rows under {source}")
    if target_parts is None and max_rows_per_file is None:
        raise ValueError("give target_parts or max_rows_per_file")
    parts = target_parts or math.ceil(before / max_rows_per_file)
    limit = max_rows_per_file or before
    write_tokens(spark.read.parquet(source), target, max_rows_per_file=limit, parts=parts, overwrite=True)
    manifest = part_manifest(spark, target)
    after = spark.read.parquet(target).count()
    if after != before:
        raise ValueError(f"row count changed from {before} to {after}")
    return manifest


def merge_parquet(spark: SparkSession, source: str, target: str, parts: int) -> int:
    """Rewrite any Parquet folder as at most ``parts`` files, in ranges of row_id where it has them, and verify the rows.

    Where these would be larger than one task writes there are more of them (``fitting_parts``).
    """
    df = spark.read.parquet(source)
    before, parts = df.count(), fitting_parts(df, parts)
    ordered = df.repartitionByRange(parts, "row_id") if "row_id" in df.columns else df.repartition(parts)
    ordered.write.mode("overwrite").parquet(target)
    after = spark.read.parquet(target).count()
    if after != before:
        raise ValueError(f"row count changed from {before} to {after}")
    return after


def write_colocated(df: DataFrame, path: str, parts: int | None = None, folders: tuple[str, ...] = (), overwrite: bool = False) -> DataFrame:
    """Rows in buckets of row_id; tables with as many buckets are joined by row_id without moving a row."""
    spark = df.sparkSession
    note = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.layout")
    files = note.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(note):
        if not overwrite:
            return read_colocated(spark, path)
        for old in (note, note.getParent().suffix(f"/{path.rstrip('/').rsplit('/', 1)[1]}")):
            files.delete(old, True)
    return colocated(df, ["row_id"], path, parts, folders)


def write_processed(processed: DataFrame, path: str, overwrite: bool = False) -> None:
    """Encoded rows in one folder per split."""
    processed.write.partitionBy("split").mode(save_mode(overwrite)).parquet(path)


def write_predictions(predictions: DataFrame, path: str, overwrite: bool = True) -> None:
    predictions.write.mode(save_mode(overwrite)).parquet(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A small report as CSV and JSON lines."""
    summary.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    summary.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/json")
