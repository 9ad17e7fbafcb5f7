"""Long token table: parsing, merging of sources, clean-up, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.functions.parsing import raw_tokens, token_parts
from adlattice.functions.scalars import finite_or_zero, is_finite
from adlattice.operators.joins import spread_join
from adlattice.session import by_rows

SKELETON, COMMON = 0, 1
FIELD_KEY = ["field", "src"]
TOKEN_KEY = ["row_id", "src", "field", "fid"]


def _pieces(rows: DataFrame, column: str, src: int) -> DataFrame:
    token = rows.select("row_id", F.explode(raw_tokens(F.col(column))).alias("_token"))
    return token.select("row_id", F.lit(src).cast("byte").alias("src"), token_parts(F.col("_token")).alias("_p"))


def parse_tokens(rows: DataFrame, column: str = "feat_str", src: int = SKELETON) -> DataFrame:
    """(row_id, src, field, fid, val) of every well-formed token."""
    return _pieces(rows, column, src).where("_p.val IS NOT NULL").select("row_id", "src", "_p.*")


def parse_errors(rows: DataFrame, column: str = "feat_str", src: int = SKELETON) -> DataFrame:
    """Tokens and malformed tokens of one source, one row."""
    return _pieces(rows, column, src).agg(
        F.lit(src).cast("byte").alias("src"),
        F.count(F.lit(1)).alias("tokens_seen"),
        F.count_if(F.col("_p.val").isNull()).alias("parse_errors"),
    )


def attach_common(rows: DataFrame, common: DataFrame) -> DataFrame:
    """Skeleton rows with the common feature string of their entity, NULL where there is none.

    An entity that owns a large share of the rows is spread over many tasks.
    """
    strings = common.select("entity_id", F.col("feat_str").alias("common_str"))
    return spread_join(rows, strings, ["entity_id"], "left")


def _both_sources(joined: DataFrame) -> DataFrame:
    """(row_id, src, parts) of every token text in ``feat_str`` and ``common_str``; one pass."""

    def tagged(column: str, src: int):
        return F.transform(
            F.coalesce(raw_tokens(F.col(column)), F.array()),
            lambda t: F.struct(F.lit(src).cast("byte").alias("src"), token_parts(t).alias("p")),
        )

    both = F.concat(tagged("feat_str", SKELETON), tagged("common_str", COMMON))
    return joined.select("row_id", F.explode(both).alias("_t")).select("row_id", "_t.src", "_t.p")


def all_tokens(joined: DataFrame) -> DataFrame:
    """Well-formed tokens of both sources, tagged with their source."""
    return _both_sources(joined).where("p.val IS NOT NULL").select("row_id", "src", "p.*")


def all_parse_errors(joined: DataFrame) -> DataFrame:
    """Tokens and malformed tokens per source."""
    return _both_sources(joined).groupBy("src").agg(
        F.count(F.lit(1)).alias("tokens_seen"), F.count_if(F.col("p.val").isNull()).alias("parse_errors")
    )


def hit_ratio(rows: DataFrame, common: DataFrame) -> DataFrame:
    """Share of rows whose entity has common features; 0 for an empty table.

    Rows are collapsed to one per entity before the join.
    """
    per_entity = rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    known = common.select("entity_id", F.lit(1).alias("hit"))
    return per_entity.join(known, "entity_id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)), F.lit(0)).alias("hit_rows"),
    ).select(
        "rows", "hit_rows", F.coalesce(F.try_divide(F.col("hit_rows"), F.col("rows")), F.lit(0.0)).alias("hit_ratio")
    )


def canonical_summary(numbered: DataFrame, common: DataFrame, tokens: DataFrame, errors: DataFrame) -> DataFrame:
    """One row with the totals of a canonical build."""
    entities = numbered.agg(F.count_distinct("entity_id").alias("n"))
    token_rows = tokens.agg(F.count(F.lit(1)).alias("n"))
    bad = errors.agg(F.coalesce(F.sum("parse_errors"), F.lit(0)).alias("n"))
    return hit_ratio(numbered, common).select(
        F.col("rows").alias("samples_rows"),
        entities.scalar().alias("samples_unique_entities"),
        F.col("hit_ratio").alias("join_hit_ratio"),
        token_rows.scalar().alias("tokens_total_rows"),
        bad.scalar().alias("parse_error_tokens"),
    )


def default_src(tokens: DataFrame) -> DataFrame:
    """``src`` filled with 0 where it is NULL; added where the column is absent."""
    if "src" not in tokens.columns:
        return tokens.withColumn("src", F.lit(0).cast("byte"))
    return tokens.withColumn("src", F.coalesce("src", F.lit(0).cast("byte")))


def guard_values(tokens: DataFrame) -> DataFrame:
    """Values as doubles with NaN and infinities set to 0; ``bad_value`` marks them."""
    val = F.col("val").cast("double")
    return tokens.withColumn("bad_value", ~is_finite(val)).withColumn("val", finite_or_zero(val))


def merge_duplicates(tokens: DataFrame, how: str | Sequence[str] = "max", order: Sequence[str] = ()) -> DataFrame:
    """One row per (row_id, src, field, fid): the largest, summed or last value as ``val``.

    Several rules share one move of the tokens and give a column each, ``max_val``, ``sum_val`` or ``last_val``.
    """
    rules = {"val": how} if isinstance(how, str) else {f"{rule}_val": rule for rule in how}
    values = []
    for out, rule in rules.items():
        if rule == "max":
            value = F.max("val")
        elif rule == "sum":
            value = F.sum("val")
        elif rule == "last":
            if not order:
                raise ValueError("the last value needs order columns")
            value = F.max_by("val", F.struct(*order))
        else:
            raise ValueError(f"unknown duplicate rule {rule}")
        values.append(value.alias(out))
    return by_rows(tokens, TOKEN_KEY).groupBy(*TOKEN_KEY).agg(*values)


def tokens_in_range(tokens: DataFrame, low: int, high: int) -> DataFrame:
    """Tokens of rows low..high; the predicate reaches the Parquet scan."""
    return tokens.where(F.col("row_id").between(low, high))


def tokens_of_rows(tokens: DataFrame, rows: DataFrame) -> DataFrame:
    """Tokens of the given rows, in (row_id, src, field) order."""
    wanted = rows.select("row_id")
    return tokens.join(wanted, "row_id", "left_semi").orderBy("row_id", "src", "field", "fid")


def token_counts(tokens: DataFrame) -> DataFrame:
    """Occurrences per (field, src, fid): the shared input of top-k, ranks and vocabularies."""
    return tokens.groupBy("field", "src", "fid").agg(F.count(F.lit(1)).alias("cnt"))
