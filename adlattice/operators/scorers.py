"""First- and second-order scorers over the encoded table. The model is a table with a row per (feature, id)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adlattice.functions.arrays import truncate
from adlattice.functions.hashing import unit_hash
from adlattice.operators.encode import LABELS
from adlattice.operators.joins import broadcast_groups, fits_broadcast, spread_join
from adlattice.session import colocated, discard, durable, parts_by
from adlattice.spec import HASH_SEED, Feature, FeatureMap

KEY = ["name", "idx"]
#: The feature of the one id that all rows share, the bias; it has no part in the second order.
BIAS = ""
SPREAD = 0.1
TINY = 1e-8
#: Bytes of parameters that every task may hold: an id, a weight and the factors, 8 each.
HELD_BYTES = 192 << 20


def _weighted_ids(f: Feature) -> Column:
    """(name, id, share) of each id of a feature; values are divided by the length of the bag."""
    ids = F.col(f"{f.name}_idx")
    ids = truncate(ids, f.max_len) if f.multi_hot else F.array(ids)
    if f.use_value:
        vals = F.col(f"{f.name}_val")
        vals = truncate(vals, f.max_len) if f.multi_hot else F.array(vals)
    else:
        vals = F.transform(ids, lambda i: F.lit(1.0))
    size = F.greatest(F.size(ids), F.lit(1)).cast("double")
    return F.zip_with(
        ids, vals, lambda i, v: F.struct(F.lit(f.name).alias("name"), i.cast("long").alias("idx"), (v.cast("double") / size).alias("share"))
    )


def bag_lines(processed: DataFrame, features: FeatureMap, *extra: Column) -> DataFrame:
    """(row_id, name, idx, share): a line per id of every encoded row, and one for the bias."""
    bias = F.array(F.struct(F.lit(BIAS).alias("name"), F.lit(0).cast("long").alias("idx"), F.lit(1.0).alias("share")))
    return processed.select("row_id", *extra, F.inline(F.concat(bias, *[_weighted_ids(f) for f in features.by_name()])))


def initial_parameters(keys: DataFrame, factors: int, seed: int = HASH_SEED) -> DataFrame:
    """Weight 0 and small factors drawn from a hash of (name, id, place); sums of squared gradients are 0."""
    text = lambda k: F.concat_ws(":", "name", F.col("idx").cast("string"), F.lit(str(k)))
    drawn = [F.when(F.col("name") == BIAS, 0.0).otherwise((unit_hash(text(k), seed) - 0.5) * (2 * SPREAD)) for k in range(factors)]
    zero = F.lit(0.0)
    none = F.array().cast("array<double>")
    return keys.select(
        *KEY, zero.alias("w"), (F.array(*drawn) if factors else none).alias("v"),
        zero.alias("sw"), (F.array(*[zero] * factors) if factors else none).alias("sv"),
    )


def _looked_up(lines: DataFrame, parameters: DataFrame) -> DataFrame:
    """``lines`` with the weight and factors of their ids, NULL where there are none; they stay where they lie.

    Features with few ids are broadcast. The ids of the others are looked up apart from the lines, which get them back as a list for their row.
    """
    kept = durable(parameters.select(*KEY, "w", "v"))
    if fits_broadcast(kept):
        return lines.join(F.broadcast(kept), KEY, "left")
    few = broadcast_groups(kept, "name")
    others = F.lit(True) if not few else ~F.col("name").isin(few)
    if not lines.where(F.col("row_id").isNull() & others).isEmpty():
        return spread_join(lines, kept, KEY, "left")
    asked = lines.where(others).select("row_id", *KEY)
    told = spread_join(asked, kept.where(others), KEY, "inner").groupBy("row_id").agg(F.collect_set(F.struct(*KEY, "w", "v")).alias("_told"))
    known = lines.join(F.broadcast(kept.where(~others)), KEY, "left") if few else lines.withColumns({c: F.lit(None).cast(kept.schema[c].dataType) for c in ("w", "v")})
    own = F.get(F.filter("_told", lambda p: (p["name"] == F.col("name")) & (p["idx"] == F.col("idx"))), F.lit(0))
    both = known.join(told, "row_id", "left").withColumn("_own", F.when(others, own))
    return both.withColumns({c: F.coalesce(c, F.col("_own")[c]) for c in ("w", "v")}).drop("_told", "_own")


def _forward(lines: DataFrame, parameters: DataFrame, factors: int, fields: int) -> DataFrame:
    """``lines`` with their row's scores, and what the gradients need of the row and the field.

    A field's vector is the sum of its ids' vectors by their shares. With t the sum of the fields' vectors, the second order is
    (|t|^2 - the sum of the fields' |e|^2) / 2 / number of fields. The sum of a field's share * v * e over its ids is its |e|^2.
    """
    s = F.col("share")
    known = _looked_up(lines, parameters)
    # The window by row comes first: its partitioning by row_id serves the windows by field too.
    field, row = Window.partitionBy("row_id", "name"), Window.partitionBy("row_id")
    own = lambda k: F.coalesce(s * F.get("v", F.lit(k)), F.lit(0.0))
    out = known.withColumn("first_order", F.sum(F.coalesce(s * F.col("w"), F.lit(0.0))).over(row))
    out = out.withColumns({f"t{k}": F.sum(own(k)).over(row) for k in range(factors)})
    out = out.withColumns({f"e{k}": F.sum(own(k)).over(field) for k in range(factors)})
    squares = F.sum(sum((own(k) * F.col(f"e{k}") for k in range(factors)), F.lit(0.0))).over(row)
    total = sum((F.col(f"t{k}") * F.col(f"t{k}") for k in range(factors)), F.lit(0.0))
    return out.withColumn("second_order", (total - squares) / 2 / F.lit(float(max(1, fields))))


def _bags(lines: DataFrame) -> DataFrame:
    """One row for each row_id with all its lines as a list (``bag``); what is such a table already stays."""
    if "bag" in lines.columns:
        return lines
    extra = ["label"] if "label" in lines.columns else []
    return lines.groupBy("row_id").agg(F.collect_list(F.struct(*KEY, "share", *extra)).alias("bag"))


@dataclass(eq=False)
class _Held:
    """Parameters that every task holds: by feature, ascending ids with their weights and factors."""

    features: dict[str | None, tuple[np.ndarray, np.ndarray, np.ndarray]]
    factors: int

    @classmethod
    def of(cls, kept: DataFrame, factors: int) -> _Held:
        known = kept.where(F.col("name").isNotNull() & F.col("idx").isNotNull())
        found = known.select(*KEY, "w", *[F.get("v", F.lit(k)).alias(f"v{k}") for k in range(factors)]).toArrow()
        coded = found.column("name").combine_chunks().dictionary_encode()
        code, columns = coded.indices.to_numpy(), [found.column(c).to_numpy() for c in found.column_names[1:]]
        del found
        out = {}
        for k, name in enumerate(coded.dictionary.to_pylist()):
            at = np.flatnonzero(code == k)
            at = at[np.argsort(columns[0][at])]
            out[name] = columns[0][at], columns[1][at], np.stack([c[at] for c in columns[2:]], 1) if factors else np.zeros((len(at), 0))
        return cls(out, factors)


@dataclass
class _Seen:
    """The lines of some rows, flat, with what their rows and fields add up to."""

    row: np.ndarray
    names: list[str | None]
    code: np.ndarray
    idx: np.ndarray
    share: np.ndarray
    label: np.ndarray | None
    #: Lines whose id, share and label aren't NULL.
    whole: np.ndarray
    first_order: np.ndarray
    second_order: np.ndarray
    #: By factor, the sums of each row and, for each line, of its field.
    of_row: list[np.ndarray]
    of_field: list[np.ndarray]


def _seen(bag: pa.Array, told: pa.Array | None, held: _Held, fields: int) -> _Seen:
    """Scores and vectors as ``_forward`` has them, of all rows of a batch. A bag has the lines of a row_id, ``told`` the parameters found for it."""
    size = pc.list_value_length(bag).to_numpy()
    lines, rows = bag.flatten(), len(size)
    row, start = np.repeat(np.arange(rows), size), np.cumsum(size) - size
    column = {f.name: lines.field(i) for i, f in enumerate(lines.type)}
    whole = np.ones(len(row), bool)
    for c in ("idx", "share", "label"):
        if c in column:
            whole &= column[c].is_valid().to_numpy(zero_copy_only=False)
    coded = column["name"].dictionary_encode(null_encoding="encode")
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    idx = pc.fill_null(column["idx"], -1).to_numpy()
    share = pc.fill_null(column["share"], 0.0).to_numpy()
    label = pc.fill_null(column["label"], 0.0).to_numpy() if "label" in column else None
    has_id = column["idx"].is_valid().to_numpy(zero_copy_only=False)
    w, v = np.zeros(len(row)), np.zeros((len(row), held.factors))
    for k, name in enumerate(names):
        if name in held.features:
            ids, weights, factors = held.features[name]
            own = np.flatnonzero((code == k) & has_id)
            at = np.searchsorted(ids, idx[own])
            at[at == len(ids)] = 0
            hit = ids[at] == idx[own] if len(ids) else np.zeros(len(own), bool)
            w[own[hit]], v[own[hit]] = weights[at[hit]], factors[at[hit]]
    if told is not None:
        times = pc.fill_null(pc.list_value_length(told), 0).to_numpy()
        got = told.flatten()
        at = np.repeat(start, times) + got.field(0).to_numpy()
        w[at] = got.field(1).to_numpy()
        v[at] = got.field(2).flatten().to_numpy().reshape(len(at), held.factors)
    field = row * len(names) + code
    if rows * len(names) > 8 * len(row) + 1024:
        field = np.unique(field, return_inverse=True)[1]
    of_row, of_field, total, squares = [], [], np.zeros(rows), np.zeros(rows)
    for k in range(held.factors):
        own = share * v[:, k]
        t, e = np.bincount(row, own, rows), np.bincount(field, own)[field] if len(field) else own
        of_row.append(t)
        of_field.append(e)
        total += t * t
        squares += np.bincount(row, own * e, rows)
    return _Seen(row, names, code, idx, share, label, whole, np.bincount(row, share * w, rows), (total - squares) / 2 / max(1, fields), of_row, of_field)


def _with_parameters(lines: DataFrame, parameters: DataFrame, factors: int) -> tuple[DataFrame, _Held]:
    """Rows with their lines as lists, and the parameters that tasks hold.

    Features with few ids are held by the tasks. The lines of others, and only these, are looked up; what is found comes as a list of (place in the bag, w, v).
    """
    bags, kept = _bags(lines), durable(parameters.select(*KEY, "w", "v"))
    ids = sorted((r["n"], r["name"]) for r in kept.where(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect())
    rows, few = 0, []
    for n, name in ids:
        rows += n
        if rows * (16 + 8 * factors) > HELD_BYTES:
            break
        few.append(name)
    if len(few) == len(ids):
        return bags, _Held.of(kept, factors)
    others = ~F.col("name").isin(few) if few else F.lit(True)
    asked = bags.select("row_id", F.posexplode("bag").alias("pos", "line")).select("row_id", "line.name", "line.idx", "pos").where(others)
    found = _looked_up(asked, durable(kept.where(others))).where(F.col("w").isNotNull())
    told = found.groupBy("row_id").agg(F.collect_list(F.struct("pos", "w", "v")).alias("told"))
    held = _Held.of(kept.where(F.col("name").isin(few)), factors) if few else _Held({}, factors)
    if bags.where(F.col("row_id").isNull()).isEmpty():
        return bags.join(told, "row_id", "left"), held
    return bags.join(told.withColumnRenamed("row_id", "_row"), F.col("row_id").eqNullSafe(F.col("_row")), "left").drop("_row"), held


def _of_rows(lines: DataFrame, parameters: DataFrame, factors: int, fields: int, schema: str, told_of: Callable[[pa.Array, _Seen], pa.RecordBatch]) -> DataFrame:
    """What ``told_of`` says of rows (row ids, ``_Seen``), whose lines are computed with many rows at once."""
    bags, held = _with_parameters(lines, parameters, factors)
    shared = bags.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                told = batch.column(2) if batch.num_columns > 2 else None
                with np.errstate(all="ignore"):
                    yield told_of(batch.column(0), _seen(batch.column(1), told, shared.value, fields))

    return bags.select("row_id", "bag", *[c for c in ("told",) if c in bags.columns]).mapInArrow(run, schema)


def _gradients(lines: DataFrame, parameters: DataFrame, factors: int, fields: int) -> DataFrame:
    """Gradient of the summed logistic loss by (name, id); lines carry their row's label."""
    columns = ["gw", *[f"g{k}" for k in range(factors)]]

    def told(_: pa.Array, seen: _Seen) -> pa.RecordBatch:
        logit = seen.first_order + seen.second_order
        by_share = (1 / (1 + np.exp(-logit)))[seen.row] - seen.label
        by_share *= seen.share
        bias = np.array([n == BIAS for n in seen.names], bool)[seen.code]
        rest = [np.where(bias, 0.0, by_share * (t[seen.row] - e) / max(1, fields)) for t, e in zip(seen.of_row, seen.of_field)]
        at = np.flatnonzero(seen.whole)
        order = at[np.lexsort((seen.idx[at], seen.code[at]))]
        code, idx = seen.code[order], seen.idx[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), bool), (code[1:] != code[:-1]) | (idx[1:] != idx[:-1]))))
        sums = [np.add.reduceat(x[order], first) if len(first) else np.zeros(0) for x in (by_share, *rest)]
        names = pa.array(seen.names, pa.string()).take(pa.array(code[first]))
        return pa.RecordBatch.from_arrays([names, pa.array(idx[first]), *map(pa.array, sums)], [*KEY, *columns])

    parts = _of_rows(lines, parameters, factors, fields, "name string, idx long, " + ", ".join(f"{c} double" for c in columns), told)
    return parts.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in columns])


def _stepped(parameters: DataFrame, gradients: DataFrame, n: int, factors: int, rate: float, reg: float) -> DataFrame:
    """Parameters after one step whose length follows each one's own squared gradients; untouched ones stay."""
    joined = parameters.join(gradients, KEY, "left")
    w = F.col("gw") / n + reg * F.col("w")
    v = [F.col(f"g{k}") / n + reg * F.col("v")[k] for k in range(factors)]
    sw, sv = F.col("sw") + w * w, [F.col("sv")[k] + v[k] * v[k] for k in range(factors)]
    moved = lambda at, g, s: at - rate * g / (F.sqrt(s) + TINY)
    touched = F.col("gw").isNotNull()
    keep = lambda c, new: F.when(touched, new).otherwise(F.col(c)).alias(c)
    lists = [keep("v", F.array(*[moved(F.col("v")[k], v[k], sv[k]) for k in range(factors)])), keep("sv", F.array(*sv))] if factors else ["v", "sv"]
    return joined.select(*KEY, keep("w", moved(F.col("w"), w, sw)), lists[0], keep("sw", sw), lists[1])


def fit(
    lines: DataFrame,
    factors: int = 0,
    fields: int = 1,
    passes: int = 2,
    batches: int = 2,
    rate: float = 0.1,
    reg: float = 1e-4,
    seed: int = HASH_SEED,
) -> DataFrame:
    """(name, idx, w, v): parameters after so many passes over ``lines`` (``bag_lines`` with the 0/1 ``label`` of their row).

    Rows fall into batches by their row_id. The lines are written once, a list for each row, bucketed by row_id: a step reads the rows of its
    batch, looks the parameters up, and moves the rows no further. Gradients are summed by (name, id) inside the
    tasks before they are shuffled, so that an id of all rows is no burden. Every step writes the table of parameters anew; only
    the number of rows of each batch reaches the driver.
    """
    batch = F.pmod(F.col("row_id"), F.lit(batches))
    chosen = lines.select("row_id", *KEY, "share", F.col("label").cast("double").alias("label"))
    rows = colocated(_bags(chosen).withColumn("batch", batch), ["row_id"], parts=parts_by(chosen, ["row_id"]))
    counted = F.sum(F.size(F.filter("bag", lambda p: p["name"] == BIAS))).alias("n")
    sizes = {r["batch"]: r["n"] for r in rows.groupBy("batch").agg(counted).collect() if r["n"]}
    parameters = durable(initial_parameters(rows.select(F.inline("bag")).select(*KEY).distinct(), factors, seed))
    for _ in range(passes):
        for b in sorted(sizes):
            gradients = _gradients(rows.where(F.col("batch") == b), parameters, factors, fields)
            after = durable(_stepped(parameters, gradients, sizes[b], factors, rate, reg))
            discard(parameters)
            parameters = after
    discard(rows)
    return parameters.select(*KEY, "w", "v")


def scores(lines: DataFrame, parameters: DataFrame, factors: int, fields: int) -> DataFrame:
    """(row_id, first_order, second_order) of every row with lines; ids without parameters add nothing."""

    def told(rows: pa.Array, seen: _Seen) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([rows, pa.array(seen.first_order), pa.array(seen.second_order)], ["row_id", "first_order", "second_order"])

    kind = lines.schema["row_id"].dataType.simpleString()
    return _of_rows(lines, parameters, factors, fields, f"row_id {kind}, first_order double, second_order double", told)


def given_scores(lines: DataFrame, weights: DataFrame, factors: int, fields: int) -> DataFrame:
    """First- and second-order score of each row under stored weights.

    ``lines`` has (row_id, name, idx, weight), ``weights`` (name, idx, w, v) with ``factors`` entries in v, ``fields`` is the number of
    features. Line weights are divided by the length of their bag, the lines of one feature in one row.
    """
    bag = Window.partitionBy("row_id", "name")
    share = F.col("weight") / F.count(F.lit(1)).over(bag)
    seen = _forward(lines.repartition("row_id").withColumn("share", share), weights, factors, fields)
    return seen.groupBy("row_id").agg(F.first("first_order").alias("first_order"), F.first("second_order").alias("second_order"))


def _scored(processed: DataFrame, features: FeatureMap, split: str, factors: int, **settings) -> DataFrame:
    """Click model of all training rows, conversion model of the clicked ones; logits of every row."""
    kept = colocated(processed, ["row_id"])
    # Rows without a row_id get no logits, as the join below leaves them out.
    bags, fields = _bags(bag_lines(kept.where(F.col("row_id").isNotNull()), features)), len(list(features))
    bags = colocated(bags, ["row_id"], parts=parts_by(kept, ["row_id"]))
    train = kept.where(F.col("split") == split)
    out = kept.select(*LABELS, *[c for c in ("split",) if c in kept.columns])
    for task, rows in (("ctr", train), ("cvr", train.where("click_mask = 1"))):
        model = fit(bag_lines(rows, features, F.col(f"y_{task}").alias("label")), factors, fields, **settings)
        logit = (F.col("first_order") + F.col("second_order")).alias(f"{task}_logit")
        out = out.join(scores(bags, model, factors, fields).select("row_id", logit), "row_id", "left")
    return out


def linear_scores(processed: DataFrame, features: FeatureMap, split: str = "train", **settings) -> DataFrame:
    """First-order scores of both tasks: logistic regression on the bag-normalised ids."""
    return _scored(processed, features, split, 0, **settings)


def factorisation_scores(processed: DataFrame, features: FeatureMap, split: str = "train", factors: int = 4, **settings) -> DataFrame:
    """First- and second-order scores of both tasks from a factorisation machine over the fields."""
    return _scored(processed, features, split, factors, **settings)
