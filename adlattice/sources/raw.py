"""Readers for the raw exposure log and the common-feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from adlattice.operators.joins import checked_broadcast

SKELETON_SCHEMA = T.StructType(
    [
        T.StructField("c0", T.LongType()),
        T.StructField("y1", T.ByteType()),
        T.StructField("y2", T.ByteType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("c4", T.IntegerType()),
        T.StructField("feat_str", T.StringType()),
    ]
)
COMMON_SCHEMA = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("nnz", T.LongType()),
        T.StructField("feat_str", T.StringType()),
    ]
)
FILE_ORDER = ["_file", "_block", "_line"]


def _scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headerless CSV with its position in file order; an empty text stays an empty text."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").option("header", "false").csv(path)
    texts = {f.name for f in schema if isinstance(f.dataType, T.StringType)}
    columns = [F.coalesce(c, F.lit("")).alias(c) if c in texts else F.col(c) for c in schema.names]
    return df.select(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def read_skeleton(spark: SparkSession, path: str) -> DataFrame:
    """Exposure rows c0, y1, y2, entity_id, c4, feat_str; malformed rows fail the job."""
    return _scan(spark, path, SKELETON_SCHEMA).drop(*FILE_ORDER)


def read_common(spark: SparkSession, path: str) -> DataFrame:
    """One feature string per entity: the last row of an entity in file order wins."""
    rows = _scan(spark, path, COMMON_SCHEMA)
    last = F.max_by("feat_str", F.struct(*FILE_ORDER))
    return rows.groupBy("entity_id").agg(last.alias("feat_str"))


def number_lines(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """``row_id`` of each scanned row by the split table; rows outside their counted split fail the job."""
    at = F.col("_line") - F.col("_first")
    outside = F.raise_error(F.lit("input splits changed between two scans")).cast("long")
    row_id = F.when((at >= 0) & (at < F.col("_n")), F.col("_before") + at).otherwise(outside)
    return rows.join(checked_broadcast(splits), ["_file", "_block"], "left").withColumn("row_id", row_id)


def split_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every input split and of all splits before it."""
    rows = _scan(spark, path, SKELETON_SCHEMA)
    splits = rows.groupBy("_file", "_block").agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select(
        "_file", "_block", "_first", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )


def require_all_rows(numbered: DataFrame, splits: DataFrame, nrows: int | None = None) -> None:
    """Fails where a written table of numbered rows has another number of rows than were counted, or leaves a number out."""
    counted = splits.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    wanted = counted if nrows is None else min(nrows, counted)
    got = numbered.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("row_id") + 1, F.lit(0)).alias("ids")).first()
    if (got["n"], got["ids"]) != (wanted, wanted):
        raise ValueError(f"{wanted} rows were counted, {got['n']} came with numbers up to {got['ids']}")


def with_row_ids(spark: SparkSession, path: str, nrows: int | None = None, splits: DataFrame | None = None) -> DataFrame:
    """Skeleton rows numbered 0..n-1 in file order; ``nrows`` keeps the first rows only.

    Rows are counted per input split and shifted by the rows of the splits before. Only the split
    table (one row per 128 MB of input) is ordered; the rows themselves do not move. A scan that is
    split otherwise than the counted one fails the job: no row is lost or numbered twice unnoticed.
    """
    rows = _scan(spark, path, SKELETON_SCHEMA)
    numbered = number_lines(rows, split_table(spark, path) if splits is None else splits).select("row_id", *SKELETON_SCHEMA.names)
    return numbered if nrows is None else numbered.where(F.col("row_id") < nrows)


def samples_of(numbered: DataFrame) -> DataFrame:
    """The samples table: labels and ids without the feature string."""
    return numbered.select("row_id", "y1", "y2", "entity_id", "c4", "c0")
