"""Joins that stay even when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adlattice.session import durable

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 256 << 20
SLOT_ROWS = 1_000_000
MAX_HOT = 100_000


def _line_bytes(field: T.StructField) -> Column:
    """About the memory a value takes."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        size = F.octet_length(c) + 16
    elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        size = 16 + 8 * F.octet_length(F.to_json(F.struct(c)))
    else:
        return F.lit(16)
    return F.coalesce(size, F.lit(16))


def fits_broadcast(kept: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a written table has few enough rows and bytes. One too large on disk isn't read for it."""
    on_disk = int(str(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if on_disk > max_bytes:
        return False
    line = sum((_line_bytes(f) for f in kept.schema), F.lit(0).cast("long"))
    got = kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(line), F.lit(0)).alias("b")).first()
    return got["n"] <= max_rows and got["b"] <= max_bytes


def broadcast_head(kept: DataFrame, order: str, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> int:
    """A bound below which ``order``, numbers from 0, has few enough rows and bytes for a broadcast: one less than a power of two, or 0.

    Rows are counted by the length of their number, so that some 60 lines at most are gathered.
    """
    line = sum((_line_bytes(f) for f in kept.schema), F.lit(0).cast("long"))
    level = F.length(F.bin(F.col(order) + 1)).alias("level")
    head, rows, size = 0, 0, 0
    for r in kept.groupBy(level).agg(F.count(F.lit(1)).alias("n"), F.sum(line).alias("b")).orderBy("level").collect():
        rows, size = rows + r["n"], size + r["b"]
        if rows > max_rows or size > max_bytes:
            break
        head = (1 << r["level"]) - 1
    return head


def broadcast_groups(kept: DataFrame, group: str, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> list:
    """The smallest groups of a written table that together have few enough rows and bytes for a broadcast; there must be few groups."""
    line = sum((_line_bytes(f) for f in kept.schema), F.lit(0).cast("long"))
    out, rows, size = [], 0, 0
    for r in sorted(kept.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(line).alias("b")).collect(), key=lambda r: (r["n"], r["b"])):
        rows, size = rows + r["n"], size + r["b"]
        if rows > max_rows or size > max_bytes:
            break
        out.append(r[group])
    return out


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write ``df`` once, measure it, and hint a broadcast only when it is small enough.

    Beyond the bounds the table is returned without a hint and the join shuffles.
    """
    kept = durable(df)
    return F.broadcast(kept) if fits_broadcast(kept, max_rows) else kept


def hot_keys(df: DataFrame, on: Sequence[str], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Keys that own more rows than one slot takes, with the number of slots each needs.

    A slot takes ``slot_rows`` rows, or more where the whole would need over ``MAX_HOT`` of them: so
    there are at most ``MAX_HOT`` such keys and twice as many slots. NULL keys meet nothing and
    aren't listed.
    """
    counts = df.dropna(subset=list(on)).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    size = F.greatest(F.lit(slot_rows), F.ceil(total.scalar() / F.lit(MAX_HOT)))
    return counts.where(F.col("_n") > size).select(*on, F.ceil(F.col("_n") / size).cast("int").alias("_slots"))


def spread_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] = ("row_id",),
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """``rows`` join ``table`` with each hot key of ``rows`` spread over as many slots as its rows need.

    Only hot keys are repeated on the table side. Rows with a NULL key, which meet nothing, are
    spread freely. ``how`` is inner, left or left_semi.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"cannot spread a {how} join")
    hot = F.broadcast(durable(hot_keys(rows, on, slot_rows)))
    draw = F.xxhash64(*spread_by)
    no_key = F.lit(False)
    for k in on:
        no_key = no_key | F.col(k).isNull()
    slot = F.when(no_key, draw).when(F.col("_slots").isNotNull(), F.pmod(draw, F.col("_slots"))).otherwise(F.lit(0))
    left = rows.join(hot, list(on), "left").withColumn("_slot", slot.cast("long")).drop("_slots")
    slots = F.sequence(F.lit(0).cast("long"), F.coalesce("_slots", F.lit(1)).cast("long") - 1)
    right = table.join(hot, list(on), "left").withColumn("_slot", F.explode(slots)).drop("_slots")
    return left.join(right, [*on, "_slot"], how).drop("_slot")


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] = ("row_id",),
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join with a table of short rows: broadcast when it is measured small, else spread.

    The table is written once, unless it is read from files already, so that measuring and joining
    read the same rows.
    """
    kept = durable(table)
    if fits_broadcast(kept, max_rows):
        return rows.join(F.broadcast(kept), list(on), how)
    return spread_join(rows, kept, on, how, spread_by)
