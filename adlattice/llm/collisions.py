"""Links between embeddings with a cosine of 0.95 or more, by collision counting over sorted one-dimensional projections.

Different vectors are nodes; equal ones are counted. A node has a value on each of many random lines. In a sorted line, two nodes
collide if one lies in the window of half-width ``WINDOW`` around the other. On one line alone the window holds a fixed share of all nodes, so
windows over whole lines would give a fixed share of all pairs. Each line is therefore sorted within cells: nodes
with the same signs on ``bits`` more lines, where ``bits`` grows with the logarithm of the number of nodes so that a window holds about
``COMPANIONS`` strangers at every size. Lines are independent, so the collisions of two nodes with a given cosine
are binomial: ``lines_for`` takes the fewest lines on which a pair at the threshold has ``COLLISIONS`` collisions or more with
probability ``RECALL``. Pairs with so many collisions are verified in double precision; closer pairs collide more often.

Large groups of near copies. A set of nodes within half the threshold's angle of a common centre is linked throughout, whatever
its size, so its pairs needn't be made. Centres are the means of crowded fine cells (``CROWDED`` nodes or more); a node joins the most crowded centre
that it meets in a cell of any line and that is near enough. Nodes of one core aren't compared. All else of a crowded cell is compared in
blocks of ``BLOCK`` nodes, sorted by value: nodes outside its largest core with each other and with that core, never that core with itself.

Components are labelled over cores and single nodes by repeated joins. Nothing but counts reaches the driver.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no links, are their own component and
are kept; vectors with different numbers of components don't link. Rows that repeat a vector are linked with each other, also with
one vec_id. ``component_id`` is the least vec_id that isn't null (null if there is none); ``kept`` compares null-safely.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.llm import scan
from adlattice.llm.near_dup import _Steps, connected
from adlattice.operators.joins import checked_broadcast, fits_broadcast, lookup_join, spread_join

COSINE = 0.95
RECALL = 0.99999
COLLISIONS = 2
COMPANIONS = 4
WINDOW = 0.63
CROWDED = 128
FINE_BITS = 6
BLOCK = 1024
SEED = 12

RESULT = "vec_id long, n_links long, component_id long, kept boolean"


# ---- calibration ----


def chance(cosine: float, bits: int, window: float = WINDOW) -> float:
    """Probability that two vectors collide on a line: the same signs on ``bits`` lines, and values at most ``window`` apart."""
    apart = math.sqrt(max(2 - 2 * cosine, 1e-300))
    return (1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi) ** bits * math.erf(window / apart / math.sqrt(2))


def bits_for(nodes: int, companions: float = COMPANIONS, window: float = WINDOW) -> int:
    """Sign lines of a cell, so that a window holds about so many unrelated nodes."""
    return max(0, math.ceil(math.log2(max(1.0, nodes * chance(0.0, 0, window) / companions))))


def lines_for(cosine: float, bits: int, recall: float = RECALL, collisions: int = COLLISIONS, window: float = WINDOW) -> int:
    """Fewest lines on which a pair of this cosine has so many collisions with that probability."""
    p, n = chance(cosine, bits, window), collisions
    while sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(collisions)) > 1 - recall:
        n += 1
    return n


@functools.lru_cache(maxsize=8)
def directions(components: int, bits: int, lines: int) -> np.ndarray:
    """Random directions (components x lines x (bits + 1)); the last of each line is the sorted one."""
    r = np.random.default_rng([SEED, components])
    return r.standard_normal((lines, bits + 1, components)).transpose(2, 0, 1).reshape(components, -1)


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of the lists of each length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    start = np.cumsum(size) - size
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        for lo in range(0, len(rows), 2048):
            some = rows[lo : lo + 2048]
            yield some, unit(flat[start[some, None] + np.arange(n)])


def places(vectors: np.ndarray, bits: int, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, value) of each vector on each line."""
    shown = (vectors @ directions(vectors.shape[1], bits, lines)).reshape(len(vectors), lines, bits + 1)
    cell = (shown[:, :, :bits] > 0) @ (np.int64(1) << np.arange(bits, dtype=np.int64)) if bits else np.zeros(shown.shape[:2], np.int64)
    number = (np.int64(vectors.shape[1]) << np.int64(48)) + (np.arange(lines, dtype=np.int64) << np.int64(36))
    return cell.astype(np.int64) + number, shown[:, :, bits]


# ---- jobs ----


def _vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, v): node numbers the different vectors; null for those that link with nothing."""
    double = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    finite = F.forall("d", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("d", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", double.alias("d"))
    return rows.select("vec_id", F.when(finite, F.xxhash64("d")).alias("node"), F.when(finite, F.col("embedding")).alias("v"))


def _posted(nodes: DataFrame, bits: int, lines: int) -> DataFrame:
    """(key, value, node, core): every node's cell and value on every line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, core = batch.column(0), batch.column(1)
            for rows, own in _by_length(batch.column(2)):
                key, value = places(own, bits, lines)
                at = pa.array(np.repeat(rows, lines))
                columns = [pa.array(key.reshape(-1)), pa.array(value.reshape(-1)), node.take(at), core.take(at)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "value", "node", "core"])

    return nodes.select("node", "core", "v").mapInArrow(run, "key long, value double, node long, core long")


def _near(pairs: DataFrame, cosine: float) -> DataFrame:
    """Rows whose vectors ``one`` and ``two`` have that cosine, without the vectors."""
    rest = [f for f in pairs.schema.fields if f.name not in ("one", "two")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            one, two = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            for rows, x in _by_length(one):
                other = two.take(pa.array(rows))
                fits = np.diff(other.offsets.to_numpy()) == x.shape[1]
                if fits.any():
                    flat = other.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    keep[rows[fits]] = (x[fits] * unit(flat.reshape(-1, x.shape[1]))).sum(axis=1) >= cosine
            yield batch.select(list(range(len(rest)))).filter(pa.array(keep))

    names = [f.name for f in rest]
    return pairs.select(*names, "one", "two").mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest))


def _cores(nodes: DataFrame, bits: int, lines: int, cosine: float, crowded: int, save: _Steps) -> DataFrame | None:
    """(node, core, label, core_n): the nodes of cores, each core's least node and its number of rows; None without cores."""
    bare = nodes.select("node", F.lit(None).cast("long").alias("core"), "v")
    cells = save(_posted(bare, bits + FINE_BITS, 1).select("node", F.col("key").alias("fine")))
    full = save(cells.groupBy("fine").agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") >= crowded))
    if full.isEmpty():
        return None
    members = cells.join(checked_broadcast(full.select("fine")), "fine").join(nodes, "node")
    v = F.transform("v", lambda x: x.cast("double"))
    large = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    scaled = members.select("fine", v.alias("v"), large.alias("large")).select("fine", F.transform("v", lambda x: x / F.col("large")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    parts = scaled.select("fine", length.alias("length"), F.posexplode("v").alias("at", "x"))
    mean = parts.groupBy("fine", "at").agg(F.avg(F.col("x") / F.col("length")).alias("x")).groupBy("fine")
    centre = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("v"))
    centres = save(centre.where(F.exists("v", lambda x: x != 0)).join(full, "fine"))
    # Of the centres of a cell, the most crowded one meets the nodes there.
    met = _posted(centres.select(F.col("fine").alias("node"), F.lit(None).cast("long").alias("core"), "v"), bits, lines)
    top = F.max(F.struct("crowd", "fine")).alias("top")
    leaders = save(met.select("key", F.col("node").alias("fine")).join(checked_broadcast(full), "fine").groupBy("key").agg(top))
    named = leaders.select("key", F.col("top.fine").alias("fine"))
    posted = _posted(bare, bits, lines).select("key", "node")
    met = posted.join(F.broadcast(named), "key") if fits_broadcast(leaders) else spread_join(posted, named, ["key"], "inner", ["node"])
    both = met.distinct().join(nodes.select("node", F.col("v").alias("one")), "node")
    both = lookup_join(both, centres.select("fine", F.col("v").alias("two")), ["fine"], "inner", ["node"])
    # Two nodes within this angle of the centre are linked, also after rounding.
    near = _near(both, math.cos(math.acos(cosine) / 2 - 1e-7))
    chosen = lookup_join(near, full, ["fine"], "inner", ["node"]).groupBy("node").agg(F.max(F.struct("crowd", "fine")).alias("top"))
    chosen = save(chosen.select("node", F.col("top.fine").alias("core")))
    sizes = chosen.join(nodes.select("node", "n"), "node").groupBy("core").agg(F.min("node").alias("label"), F.sum("n").alias("core_n"))
    return save(lookup_join(chosen, sizes, ["core"], "inner", ["node"]))


def _dealt(posted: DataFrame, block: int, save: _Steps) -> DataFrame:
    """``posted`` with a block (i, j) of its cell that a row goes to, and the row's side there.

    Rows outside the cell's largest core are dealt into blocks that meet each other (the lower one first) and that core's blocks, which are
    numbered from -1 down. Sides are 1 and 2 where two blocks meet, and 0 where one meets itself.
    """
    counts = posted.groupBy("key", "core").agg(F.count(F.lit(1)).alias("c"))
    top = F.max(F.when(F.col("core").isNotNull(), F.struct("c", "core"))).alias("top")
    shape = counts.groupBy("key").agg(top, F.sum("c").alias("total"))
    inner = F.coalesce(F.col("top.c"), F.lit(0))
    shape = shape.select("key", F.col("top.core").alias("largest"), (F.col("total") - inner).alias("outer"), inner.alias("inner"))
    # Cells not listed are one block. Nothing is to be done in a cell that is one core.
    listed = save(shape.where((F.col("outer") + F.col("inner") > block) | (F.col("outer") == 0)))
    rows = lookup_join(posted, listed, ["key"], "left", ["node"]).where("outer IS NULL OR outer > 0")
    mine = F.coalesce(F.col("core") == F.col("largest"), F.lit(False))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(n), F.lit(0)) / block)).cast("long")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.when(mine, blocks("inner")).otherwise(blocks("outer")))
    spot = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    beside = lambda k: F.when(k == own, 0).when(own < k, 1).otherwise(2)
    meets = F.transform(upto(blocks("outer")), lambda k: spot(F.least(k, own), F.greatest(k, own), beside(k)))
    with_core = F.transform(upto(blocks("inner")), lambda k: spot(own, -1 - k, F.lit(1)))
    from_core = F.transform(upto(blocks("outer")), lambda k: spot(k, -1 - own, F.lit(2)))
    spots = F.when(mine, from_core).when(F.coalesce(F.col("inner"), F.lit(0)) > 0, F.concat(meets, with_core)).otherwise(meets)
    dealt = rows.select("key", "value", "node", "core", F.explode(spots).alias("spot"))
    in_core = F.col("core").isNotNull().alias("in_core")
    return dealt.select("key", "spot.i", "spot.j", "value", "node", F.coalesce("core", F.lit(0)).alias("core"), in_core, "spot.side")


def window_pairs(run: np.ndarray, value: np.ndarray, core: np.ndarray, side: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y), x before y, of one run whose values are at most ``window`` apart.

    Rows are sorted by (run, value). Rows of one core (above 0) don't pair, nor do two rows whose ``side`` is equal and above 0.
    """
    place = run.astype(np.float64) * 1024.0 + value
    last = np.searchsorted(place, place + window, "right")
    first = np.arange(len(place)) + 1
    xs, ys = [], []
    for lo in range(0, len(place), 1 << 14):
        count = np.maximum(last[lo : lo + (1 << 14)] - first[lo : lo + (1 << 14)], 0)
        x = np.repeat(np.arange(lo, lo + len(count)), count)
        y = scan.ragged(first[lo : lo + len(count)], count)
        ok = ((core[x] != core[y]) | (core[x] == 0)) & ((side[x] != side[y]) | (side[x] == 0))
        xs.append(x[ok])
        ys.append(y[ok])
    return np.concatenate(xs) if xs else np.zeros(0, np.int64), np.concatenate(ys) if ys else np.zeros(0, np.int64)


def _collisions(dealt: DataFrame, window: float) -> DataFrame:
    """(a, b) for every line on which two nodes collide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, i, j, value, node, core, in_core, side = (c.to_numpy() for c in table.columns)
            change = np.ones(len(key), bool)
            change[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            number = np.cumsum(change)
            core = np.where(in_core, np.unique(core, return_inverse=True)[1] + 1, 0)
            for lo, hi in _slices(number):
                x, y = window_pairs(number[lo:hi] - number[lo], value[lo:hi], core[lo:hi], side[lo:hi], window)
                ends = np.sort(np.stack((node[lo:hi][x], node[lo:hi][y])), axis=0)
                for at in range(0, len(x), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(e[at : at + (1 << 17)]) for e in ends], ["a", "b"])

        for batch in batches:
            table = pa.table(batch)
            held = table if held is None else pa.concat_tables([held, table])
            ends = [held.column(c).to_numpy() for c in range(3)]
            same = (ends[0] == ends[0][-1]) & (ends[1] == ends[1][-1]) & (ends[2] == ends[2][-1])
            whole = int(len(same) - np.count_nonzero(same))
            if whole:
                yield from found(held.slice(0, whole))
                held = held.slice(whole).combine_chunks()
        if held is not None and len(held):
            yield from found(held)

    sorted_ = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "value", "node")
    return sorted_.mapInArrow(run, "a long, b long")


def _slices(number: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of whole runs of some 2^16 rows."""
    lo = 0
    while lo < len(number):
        hi = int(np.searchsorted(number, number[min(lo + (1 << 16), len(number) - 1)], "right"))
        yield lo, hi
        lo = hi


def linked(
    vectors: DataFrame,
    cosine: float = COSINE,
    recall: float = RECALL,
    crowded: int = CROWDED,
    block: int = BLOCK,
    companions: float = COMPANIONS,
) -> DataFrame:
    """``RESULT`` for every row of ``vectors`` (vec_id, embedding)."""
    save = _Steps(vectors.sparkSession)
    rows = _vectors(vectors)
    grouped = rows.where("node IS NOT NULL").groupBy("node")
    nodes = save(grouped.agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id")))
    bits = bits_for(nodes.count(), companions)
    lines = lines_for(cosine, bits, recall)
    cores = _cores(nodes, bits, lines, cosine, crowded, save)
    if cores is None:
        none = F.lit(None).cast("long")
        nodes = nodes.withColumns({"core": none, "label": F.col("node"), "core_n": none})
    else:
        nodes = save(nodes.join(cores, "node", "left").withColumn("label", F.coalesce("label", "node")))
    hits = _collisions(_dealt(_posted(nodes, bits, lines), block, save), WINDOW)
    pairs = save(hits.groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= COLLISIONS).select("a", "b"))
    end = lambda c, v: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("label").alias(f"of_{c}"), F.col("v").alias(v))
    sides = spread_join(spread_join(pairs, end("a", "one"), ["a"], "inner", ["b"]), end("b", "two"), ["b"], "inner", ["a"])
    edges = save(_near(sides, cosine))
    both = edges.select(F.col("a").alias("node"), F.col("n_b").alias("n_linked")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("n_a").alias("n_linked"))
    )
    links = both.groupBy("node").agg(F.sum("n_linked").alias("n_linked"))
    between = edges.where("of_a <> of_b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct()
    slim = nodes.select("node", "label", "least_id", "n", "core_n").join(links, "node", "left")
    between = save(between)
    if between.isEmpty():
        named = slim.withColumn("root", F.col("label"))
    else:
        roots = connected(between, save).select(F.col("node").alias("label"), F.col("label").alias("root"))
        named = spread_join(slim, roots, ["label"], "left", ["node"]).withColumn("root", F.coalesce("root", "label"))
    named = save(named)
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    n_links = F.coalesce("core_n", "n") - 1 + F.coalesce("n_linked", F.lit(0))
    judged = spread_join(named, least, ["root"], "left", ["node"]).select("node", n_links.alias("n_links"), "component_id")
    found = spread_join(rows.select("vec_id", "node"), judged, ["node"], "left", ["vec_id"])
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return found.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
