"""Order-dependent results without a single-task window.

A window over an unbounded group runs in one task. Everything here goes two levels instead:
range-partition on (group, order), number the rows of each partition, add the totals of the
partitions before. The table of totals has at most (partitions + groups) rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adlattice.operators.joins import fits_broadcast
from adlattice.session import durable, partitions_for

PID, POS = "_layout_part", "_layout_pos"
_LOCAL_BITS = (1 << 33) - 1


def _as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lay_out(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], partitions: int | None = None
) -> DataFrame:
    """Rows range-partitioned and sorted by (group, order), with partition id and local position.

    Equal sort keys share a partition. The borders are sampled, so the outcome is written once.
    """
    keys = [F.col(g) for g in group] + [_as_column(o) for o in order]
    partitions = partitions or partitions_for(df)
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    numbered = (
        ranged.sortWithinPartitions(*keys)
        .withColumn(PID, F.spark_partition_id())
        .withColumn(POS, F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_BITS)))
    )
    return durable(numbered)


def _attach(rows: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe equi join of a totals table back to the rows.

    The totals are counted first: short ones are broadcast, so the rows stay where they are. Beyond that, totals of whole
    groups are repeated for every partition of the group, so that a large group isn't joined in one task.
    """
    named = totals.select(*[F.col(k).alias(f"_t_{k}") for k in keys], *[c for c in totals.columns if c not in keys])
    kept = durable(named)

    def matched(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
        cond = F.lit(True)
        for k in by:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
        return left.join(right, cond, "inner")

    if fits_broadcast(kept):
        return matched(rows, F.broadcast(kept), keys).drop(*kept.columns[: len(keys)])
    if PID in keys:
        return matched(rows, kept, keys).drop(*kept.columns[: len(keys)])
    parts = matched(rows.select(*keys, PID).distinct(), kept, keys).drop(*keys).withColumnRenamed(PID, f"_t_{PID}")
    by = [*keys, PID]
    return matched(rows, parts, by).drop(*[f"_t_{k}" for k in by])


def _before(group: Sequence[str]):
    return Window.partitionBy(*group).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)


def group_rank(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    out: str = "rank",
    partitions: int | None = None,
) -> DataFrame:
    """0-based row number per group; ``order`` must be total for a deterministic outcome."""
    laid = lay_out(df, group, order, partitions)
    keys = [*group, PID]
    totals = (
        laid.groupBy(*keys)
        .agg(F.min(POS).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(_before(group)), F.lit(0)))
        .drop("_n")
    )
    return (
        _attach(laid, totals, keys)
        .withColumn(out, F.col(POS) - F.col("_first") + F.col("_before"))
        .drop(PID, POS, "_first", "_before")
    )


def ordered_prefix(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    running: Mapping[str, tuple[str, str]],
    inclusive: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Running ``sum`` or ``max`` per group: ``running = {out: (kind, column)}``.

    Exclusive by default; an exclusive sum starts at 0, an exclusive max at NULL.
    """
    return _run(lay_out(df, group, order, partitions), group, running, inclusive).drop(PID, POS)


def _run(laid: DataFrame, group: Sequence[str], running: Mapping[str, tuple[str, str]], inclusive: bool) -> DataFrame:
    keys = [*group, PID]
    fold = {"sum": F.sum, "max": F.max}
    local = Window.partitionBy(*keys).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = laid.groupBy(*keys).agg(*[fold[kind](col).alias(f"_all_{out}") for out, (kind, col) in running.items()])
    for out, (kind, _) in running.items():
        totals = totals.withColumn(f"_pre_{out}", fold[kind](f"_all_{out}").over(_before(group)))
    totals = totals.drop(*[f"_all_{out}" for out in running])
    rows = _attach(laid, totals, keys)
    for out, (kind, col) in running.items():
        inner = fold[kind](col).over(local)
        if kind == "sum":
            value = F.coalesce(inner, F.lit(0)) + F.coalesce(F.col(f"_pre_{out}"), F.lit(0))
        else:
            value = F.greatest(inner, F.col(f"_pre_{out}"))
        rows = rows.withColumn(out, value)
    return rows.drop(*[f"_pre_{out}" for out in running])


def _pick(rows: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolated quantiles from (group, value, _n, _below, _total) rows."""
    v, below, above = F.col(value).cast("double"), F.col("_below"), F.col("_below") + F.col("_n")
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        for tag, target in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((below <= target) & (target < above), v)).alias(f"_{tag}_{name}"))
    got = rows.groupBy(*group).agg(F.max("_total").alias("_total"), *picks)
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        got = got.withColumn(name, lo + (hi - lo) * (at - F.floor(at)))
    return got.select(*group, *probs)


def value_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float], partitions: int | None = None
) -> DataFrame:
    """Exact interpolated quantiles of a real-valued column, however many distinct values a group has.

    ``percentile`` would hold one group's value map in one task; here the values are collapsed to
    (value, count) and cumulated over range partitions.
    """
    hist = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    if group:
        return counted_quantiles(cumulated(hist, group, value, {"n": "_n"}, partitions), group, value, probs, "_n", "below_n", "total_n")
    laid = lay_out(hist, group, [value], partitions)
    totals = laid.groupBy(*group).agg(F.sum("_n").alias("_total"))
    below = _run(laid, group, {"_below": ("sum", "_n")}, inclusive=False)
    return _pick(below.withColumn("_total", totals.scalar()), group, value, probs)


def cumulated(
    df: DataFrame, group: Sequence[str], value: str, counts: Mapping[str, str], partitions: int | None = None
) -> DataFrame:
    """Rows of a histogram (group, value, counts) with the counts of smaller values and of the whole group.

    ``counts = {name: column}`` gives ``below_<name>`` and ``total_<name>``.
    """
    laid = lay_out(df, group, [value], partitions)
    totals = laid.groupBy(*group).agg(*[F.sum(c).alias(f"total_{name}") for name, c in counts.items()])
    below = _run(laid, group, {f"below_{name}": ("sum", c) for name, c in counts.items()}, inclusive=False)
    return _attach(below, totals, group).drop(PID, POS)


def counted_quantiles(
    rows: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float], count: str, below: str, total: str
) -> DataFrame:
    """Exact interpolated quantiles from a cumulated histogram; values that don't occur have no part in them."""
    named = rows.where(F.col(count) > 0).select(
        *group, value, F.col(count).alias("_n"), F.col(below).alias("_below"), F.col(total).alias("_total")
    )
    return _pick(named, group, value, probs)


def count_quantiles(df: DataFrame, group: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles of a count-like column (occurrences, lengths).

    Positive counts that add up to at most N rows have at most sqrt(2N) distinct values, so the
    collapsed histogram is small enough for an ordinary window.
    """
    hist = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    whole = hist.withColumn("_below", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn(
        "_total", F.sum("_n").over(Window.partitionBy(*group))
    )
    return _pick(whole, group, value, probs)


def trailing_mean(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    value: str,
    width: int,
    out: str,
    chunk: int = 100_000,
    partitions: int | None = None,
) -> DataFrame:
    """Mean of the last ``width`` rows of the group, the current one included.

    The group is cut into chunks of consecutive rows; the last ``width - 1`` rows of a chunk are
    repeated at the head of the next one, so no window is longer than ``chunk + width``.
    """
    if chunk < width:
        raise ValueError("chunk must be at least as long as the window")
    ranked = group_rank(df, group, order, "_at", partitions)
    home = F.floor(F.col("_at") / F.lit(chunk))
    tail = (F.col("_at") % F.lit(chunk)) >= F.lit(chunk - width + 1)
    homes = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    copies = ranked.withColumn("_home", home).withColumn("_chunk", F.explode(homes))
    w = Window.partitionBy(*group, "_chunk").orderBy("_at").rowsBetween(-(width - 1), 0)
    return copies.withColumn(out, F.avg(value).over(w)).where("_chunk = _home").drop("_at", "_home", "_chunk")
