"""Batches of bags: flat ids with offsets, or padded rectangles.

A batch is ``batch_rows`` consecutive rows by row_id. The rows move once: they are counted in fine bins of row_id, the bins are dealt into
parts of about equal size, and a part takes along the rows behind it that its last batch may need. So every part knows the number of
rows before it, and each batch lies whole and in order in the part where it starts, where it is packed by cutting the Arrow lists of its bags.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlattice.functions.arrays import truncate
from adlattice.operators.joins import checked_broadcast
from adlattice.operators.ordered import group_rank
from adlattice.session import durable, partitions_for
from adlattice.spec import PAD_ID, Feature, FeatureMap

#: Bins of row_id per part, and how many times a part's share a bin may hold before ranks replace the row ids.
BINS = 32
UNEVEN = 4

PACKED = "batch long, field string, indices array<long>, offsets array<long>, weights array<float>"
PADDED = "batch long, pos long, field string, ids array<long>, weights array<float>, length int"
OFFSETS = "batch long, pos long, field string, ids array<long>, weights array<float>, offset long"


def _bag(f: Feature, weighted: bool) -> Column:
    """(ids, weights) of a feature; weights are null where no feature uses values."""
    ids = F.col(f"{f.name}_idx")
    ids = truncate(F.coalesce(ids, F.array()), f.max_len) if f.multi_hot else F.array(ids)
    ones = F.transform(ids, lambda i: F.lit(1.0).cast("float"))
    if not weighted:
        weights = F.lit(None).cast("array<float>")
    elif f.use_value:
        vals = F.col(f"{f.name}_val")
        vals = truncate(vals, f.max_len) if f.multi_hot else F.array(vals)
        weights = F.when(F.size(F.coalesce(vals, F.array())) == 0, ones).otherwise(vals)
    else:
        weights = ones
    return F.struct(ids.cast("array<long>").alias("ids"), weights.cast("array<float>").alias("weights")).alias(f.name)


def _counted(rows: DataFrame, parts: int) -> tuple[int, int, list[tuple[int, int]]]:
    """Least row_id, width of a bin and the rows of each bin that has any; at most ``BINS`` bins a part reach the driver."""
    ends = rows.agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).first()
    if ends["lo"] is None:
        return 0, 1, []
    width = -(-(ends["hi"] - ends["lo"] + 1) // (parts * BINS))
    at = F.floor((F.col("row_id") - ends["lo"]) / F.lit(width)).cast("long")
    got = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    return ends["lo"], width, sorted((r["bin"], r["n"]) for r in got)


def deal_bins(bins: list[tuple[int, int]], parts: int, batch_rows: int) -> list[tuple[int, int, int, int]]:
    """(bin, part, start, stop): the bins of every part, the ones taken along included.

    Rows before the part and up to its end are ``start`` and ``stop``.
    """
    total = sum(n for _, n in bins)
    share = max(1, -(-total // parts))
    own: list[list[int]] = []
    seen = 0
    for k, (_, n) in enumerate(bins):
        if seen // share >= len(own):
            own.append([])
        own[-1].append(k)
        seen += n
    out, start = [], 0
    for p, mine in enumerate(own):
        stop = start + sum(bins[k][1] for k in mine)
        more, k = -(-stop // batch_rows) * batch_rows - stop, mine[-1] + 1
        while more > 0 and k < len(bins):
            mine = [*mine, k]
            more, k = more - bins[k][1], k + 1
        out += [(bins[k][0], p, start, stop) for k in mine]
        start = stop
    return out


def _placed(processed: DataFrame, batch_rows: int, columns: list[Column]) -> DataFrame:
    """Rows in their parts, sorted, with the rows before the part and up to its end."""
    kept = durable(processed)
    parts = partitions_for(kept) or int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lo, width, bins = _counted(kept, parts)
    if bins and max(n for _, n in bins) > UNEVEN * max(batch_rows, sum(n for _, n in bins) // parts):
        kept = durable(group_rank(kept, [], ["row_id"], "_rank").drop("row_id").withColumnRenamed("_rank", "row_id"))
        lo, width, bins = _counted(kept, parts)
    dealt = deal_bins(bins, parts, batch_rows)
    table = kept.sparkSession.createDataFrame(dealt, "_bin long, _part long, _start long, _stop long")
    at = F.floor((F.col("row_id") - lo) / F.lit(width)).cast("long")
    rows = kept.select("row_id", at.alias("_bin"), *columns).join(checked_broadcast(table), "_bin")
    return rows.drop("_bin").repartition("_part").sortWithinPartitions("_part", "row_id")


def _by_batch(
    processed: DataFrame,
    features: FeatureMap,
    batch_rows: int,
    emit: Callable[[int, int, dict[str, tuple[pa.Array, pa.Array]]], Iterator[list]],
    schema: str,
    keep: Column | None = None,
) -> DataFrame:
    """What ``emit`` makes of every batch: its number, first position, the positions of its kept rows, and (ids, weights) of every feature."""
    weighted = any(f.use_value for f in features)
    names = [f.name for f in features.by_name()]
    columns = [(F.lit(True) if keep is None else F.coalesce(keep, F.lit(True))).alias("_keep")]
    rows = _placed(processed, batch_rows, [*columns, *[_bag(f, weighted) for f in features.by_name()]])

    def pack(table: pa.Table, batch: int) -> Iterator[pa.RecordBatch]:
        used = table.column("_keep").combine_chunks()
        pos = batch * batch_rows + np.flatnonzero(used.to_numpy(zero_copy_only=False))
        table = table.filter(used)
        bags = {}
        for name in names:
            own = table.column(name).combine_chunks()
            bags[name] = tuple(own.field(k) for k in (0, 1))
        yield from emit(batch, pos, bags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start, stop, seen, held = -1, 0, 0, 0, None

        def done(table: pa.Table, first: int, last: bool) -> tuple[list[pa.RecordBatch], pa.Table, int]:
            """Whole batches of rows from position ``first``; the rest, and its first position."""
            out: list[pa.RecordBatch] = []
            skip = min(-(-first // batch_rows) * batch_rows - first, len(table))
            table, first = table.slice(skip), first + skip
            while len(table) and first < stop and (len(table) >= batch_rows or last):
                out += pack(table.slice(0, batch_rows), first // batch_rows)
                table, first = table.slice(batch_rows), first + min(batch_rows, len(table))
            return out, table, first

        for batch in batches:
            of = batch.column(batch.schema.get_field_index("_part")).to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if of[a] != part:
                    if held is not None:
                        yield from done(held, seen, True)[0]
                    row = batch.slice(a, 1).to_pylist()[0]
                    part, start, stop = row["_part"], row["_start"], row["_stop"]
                    seen, held = start, None
                piece = pa.table(batch.slice(a, b - a)).drop_columns(["_part", "_start", "_stop", "row_id"])
                held = piece if held is None else pa.concat_tables([held, piece])
                out, held, seen = done(held, seen, False)
                yield from out
        if held is not None:
            yield from done(held, seen, True)[0]

    return rows.mapInArrow(run, schema)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists and all their values."""
    return column.value_lengths().fill_null(0).to_numpy(), column.flatten()


def _whole(values: pa.Array | None) -> pa.Array:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def pack_bags(processed: DataFrame, features: FeatureMap, batch_rows: int) -> DataFrame:
    """Per (batch, field): flat ``indices``, bag ``offsets`` and ``weights`` in row order.

    Rows with a broken funnel leave their batch before the offsets are counted.
    """
    weighted = any(f.use_value for f in features)

    def emit(batch: int, pos: np.ndarray, bags: dict[str, tuple[pa.Array, pa.Array]]) -> Iterator[pa.RecordBatch]:
        if not len(pos):
            return
        for name, (ids, weights) in bags.items():
            size, flat = _flat(ids)
            row = [pa.array([batch]), pa.array([name]), _whole(flat), _whole(pa.array(np.cumsum(size) - size, pa.int64()))]
            row.append(_whole(_flat(weights)[1]) if weighted else pa.nulls(1, pa.list_(pa.float32())))
            yield pa.RecordBatch.from_arrays(row, _names(PACKED))

    return _by_batch(processed, features, batch_rows, emit, PACKED, ~((F.col("y_ctr") <= 0) & (F.col("y_cvr") > 0)))


def bag_offsets(processed: DataFrame, features: FeatureMap, batch_rows: int) -> DataFrame:
    """One line per (row, feature) with its bag and the bag's start inside its (batch, field)."""

    def emit(batch: int, pos: np.ndarray, bags: dict[str, tuple[pa.Array, pa.Array]]) -> Iterator[pa.RecordBatch]:
        for name, (ids, weights) in bags.items():
            size, _ = _flat(ids)
            columns = [np.full(len(pos), batch), pos, pa.array([name] * len(pos), pa.string()), ids, weights, np.cumsum(size) - size]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], _names(OFFSETS))

    return _by_batch(processed, features, batch_rows, emit, OFFSETS)


def _padded(column: pa.Array, width: int, fill: float, kind: pa.DataType) -> pa.Array:
    """Lists filled up to ``width``; null lists stay null."""
    size, flat = _flat(column)
    out = np.full((len(size), width), fill, kind.to_pandas_dtype())
    out[np.arange(width) < size[:, None]] = flat.to_numpy(zero_copy_only=False)
    edges = pa.array(np.arange(len(size) + 1) * width, pa.int32())
    return pa.ListArray.from_arrays(edges, pa.array(out.reshape(-1), kind), mask=column.is_null())


def pad_batches(processed: DataFrame, features: FeatureMap, batch_rows: int) -> DataFrame:
    """One line per (row, multi-hot feature): ids and values padded to the longest bag of the batch."""
    multi = FeatureMap(tuple(f for f in features if f.multi_hot))

    def emit(batch: int, pos: np.ndarray, bags: dict[str, tuple[pa.Array, pa.Array]]) -> Iterator[pa.RecordBatch]:
        for name, (ids, weights) in bags.items():
            size, _ = _flat(ids)
            width = int(size.max()) if len(size) else 0
            columns = [pa.array(np.full(len(pos), batch)), pa.array(pos), pa.array([name] * len(pos), pa.string())]
            columns += [_padded(ids, width, PAD_ID, pa.int64()), _padded(weights, width, 0.0, pa.float32()), pa.array(size, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, _names(PADDED))

    return _by_batch(processed, multi, batch_rows, emit, PADDED)
