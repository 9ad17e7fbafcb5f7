"""Near-duplicate documents by an inverted join of MinHash signatures.

A document is its set of distinct shingles (``SHINGLE`` consecutive lower-cased words; all words where it has fewer). Its
signature has ``COORDINATES`` values, the least of its shingles under as many hash functions. A document is posted under
its (coordinate, value) pairs, and two documents are candidates if their signatures agree in ``MATCHES`` coordinates or
more; at similarity 0.8 a pair misses that with probability 4.2e-6. Candidates are confirmed on full sets.

Prefix merging. In one order for all documents, rarest pairs first, two signatures with ``MATCHES`` common pairs share
one among the first ``COORDINATES - MATCHES + 1`` of either. Only those are posted, which leaves out what many documents
share, such as a common passage. Pairs that one document alone has are counted and not posted.

Skip merging. Documents of one component need no comparison with each other. Equal sets are one node from the start. Then
every posting list is compared with its most central member, the one with the fewest pairs of its own, and what is
confirmed is united; a large group of near copies becomes one component by that. In lists that still hold several
components, documents go that no other can match: if ``m`` of a document's ``n`` shingles occur in another document of
these lists, its similarity to one of ``k`` shingles is at most m / (n + k - m). What is left is compared in blocks, the
documents outside a list's largest component with each other and with that component, never that component with itself.
A pair is counted in the first list that it shares. Pairs with enough matches and a sufficient bound stay in their block:
the sets of its documents are brought there, overlaps are counted for all of them at once, and only links leave.

Components are labelled by their least node: repeated joins of the edges with the labels, and of the labels with themselves.
Nothing but counts reaches the driver.

Defined results: null texts and texts without words have an empty set, no links, and are kept; a null doc_id takes part in
links, ``component_id`` is the least doc_id that isn't null (null if there is none), and ``kept`` compares null-safely, so
rows that repeat the least doc_id with a text of the component are all kept; other columns are ignored by ``components`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlattice.llm import scan
from adlattice.session import discard, fresh_path

SHINGLE = 4
SIMILARITY_PERCENT = 80
COORDINATES = 64
MATCHES = 36
PREFIX = COORDINATES - MATCHES + 1
LEADER_ROUNDS = 2
BLOCK = 256
#: A table of pairs of numbers is broadcast up to this many rows (some 10 MB).
FEW_PAIRS = 200_000

RESULT = "doc_id long, n_shingles long, component_id long, kept boolean"

_FACTORS = scan.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_FOLD = np.uint64(0xC6A4A7935BD1E995)


# ---- sets and signatures ----


def shingle_sets(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text of a chunk."""
    hashes, _, _, first = scan.words(data, off, scan.SOLID)
    folded = hashes
    for k in range(1, shingle):
        folded = folded[: max(0, len(hashes) - k)] * _FOLD + hashes[k:]
    folded = scan.mix(folded)
    for a, b in zip(first.tolist(), first[1:].tolist()):
        if b - a >= shingle:
            yield np.unique(folded[a : b - shingle + 1])
        elif b > a:
            value = hashes[a : a + 1]
            for k in range(a + 1, b):
                value = value * _FOLD + hashes[k]
            yield scan.mix(value + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def signature(own: np.ndarray) -> np.ndarray:
    """32 bits of the least value under each hash function."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(own), 2048):
        np.minimum(least, (own[lo : lo + 2048, None] * _FACTORS).min(axis=0), out=least)
    return (scan.mix(least) >> np.uint64(32)).astype(np.uint32)


def set_name(own: np.ndarray) -> int:
    """One number for equal sets."""
    total = scan.mix(own ^ _FOLD).sum(dtype=np.uint64) + np.uint64(len(own))
    return int(scan.mix(np.array([total], np.uint64)).view(np.int64)[0])


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILARITY_PERCENT) -> bool:
    """Whether two sorted sets overlap by so many hundredths of their union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    place = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
    common = int((b[place] == a).sum()) if len(b) else 0
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


# ---- jobs ----


class _Steps:
    """Tables of one run, written to the shared folder and read again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.n = spark, fresh_path(spark, "near-dup"), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.option("compression", "zstd").parquet(f"{self.path}/{self.n}")
        return self.spark.read.parquet(f"{self.path}/{self.n}")


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_key, n, node, signature) of every row; node and signature are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in scan.chunks(batch.column(2)):
                sets = list(shingle_sets(data, off, shingle))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(lo, hi - lo) for c in (0, 1)],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_name(s) if len(s) else None for s in sets], pa.int64()),
                        pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "text_key", "n", "node", "signature"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_key long, n long, node long, signature binary")


def _postings(nodes: DataFrame) -> DataFrame:
    """(key, node): a number for every (coordinate, value) pair of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(COORDINATES, dtype=np.uint64)
        for batch in batches:
            raw, _ = scan.utf8(batch.column(1))
            values = raw.view(np.uint32).reshape(-1, COORDINATES).astype(np.uint64)
            keys = values * np.uint64(COORDINATES) + place
            node = np.repeat(batch.column(0).to_numpy(), COORDINATES)
            for lo in range(0, len(node), 1 << 18):
                some = slice(lo, lo + (1 << 18))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)[some].view(np.int64)), pa.array(node[some])], ["key", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key long, node long")


def _prefixes(nodes: DataFrame, prefix: int) -> DataFrame:
    """(node, alone, keys): how many pairs a node alone has, and the others among its first ``prefix``."""
    postings = _postings(nodes)
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    own = postings.join(shared, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("pairs"))
    alone = F.lit(COORDINATES) - F.size("pairs")
    posted = own.where(alone < prefix)
    return posted.select("node", alone.alias("alone"), F.slice("pairs", F.lit(1), F.lit(prefix) - alone)["key"].alias("keys"))


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, own): full sets of the wanted (node, doc_id, text_key); a node whose row repeats comes once from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            fresh = [not (k in done or done.add(k)) for k in batch.column(0).to_pylist()]
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            for lo, hi, data, off in scan.chunks(batch.column(1)):
                own = [s.tobytes() for s in shingle_sets(data, off, shingle)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(own, pa.binary())], ["node", "own"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    small = F.broadcast(wanted) if wanted.count() <= FEW_PAIRS else wanted
    texts = rows.join(small, (rows["text_key"] == small["text_key"]) & rows["id"].eqNullSafe(small["doc_id"]))
    return texts.select("node", rows["text"]).mapInArrow(run, "node long, own binary")


def _one_each(sets: DataFrame, wanted: DataFrame, save: _Steps) -> DataFrame:
    """``sets`` with one row per node; they are moved only if a node came from several tasks."""
    return sets if sets.count() == wanted.count() else save(sets.groupBy("node").agg(F.first("own").alias("own")))


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """(a, b, one, two): the values of both nodes of each pair. Two rows per pair are shuffled."""
    few = pairs.count() <= FEW_PAIRS
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node"))
    values = table.join(F.broadcast(sides) if few else sides, "node").groupBy("a", "b")
    of = lambda c: F.max(F.when(F.col("node") == F.col(c), F.col(column)))
    return values.agg(of("a").alias("one"), of("b").alias("two"))


def _filtered(pairs: DataFrame, accept, kind: type = np.uint64) -> DataFrame:
    """(a, b) of the pairs whose two values, as arrays of unsigned numbers, are accepted."""
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ((raw.view(kind), off // width) for raw, off in (scan.utf8(batch.column(c)) for c in (2, 3)))
            keep = [
                accept(one[0][a:b], two[0][c:d]) for a, b, c, d in zip(one[1], one[1][1:], two[1], two[1][1:])
            ]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "one", "two").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, matches: int, percent: int, save: _Steps) -> DataFrame:
    """Edges (a, b) among candidate pairs: enough matches of the signatures, then enough overlap of the sets."""
    matched = save(_filtered(_both(pairs, nodes, "signature"), lambda x, y: int((x == y).sum()) >= matches, np.uint32))
    return save(_filtered(_both(matched, sets, "own"), lambda x, y: similar(x, y, percent)).distinct())


def connected(edges: DataFrame, save: _Steps) -> DataFrame:
    """(node, label): the least node of the component of every node that has an edge."""
    both = save(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = save(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")))
    while True:
        near = (
            both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        )
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("before"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("jump"))
        after = save(lower.join(jump, "next", "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("label"), "before"))
        labels = after.select("node", "label")
        if after.where("label <> before").isEmpty():
            return labels


def _united(labels: DataFrame, edges: DataFrame, save: _Steps) -> DataFrame:
    """Labels after the components of each edge are united."""
    named = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    between = edges.join(named("a"), "a").join(named("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    between = save(between.where("a <> b").distinct())
    if between.isEmpty():
        return labels
    to = connected(between, save).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return save(labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def _open(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, alone, label) of the lists that hold several components."""
    named = postings.join(labels, "node")
    several = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    return named.join(several, "key").select("key", "node", "alone", "label")


def _with_leader(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of every list's most central member with the members of other components."""
    drawn = F.struct("alone", F.xxhash64("node", F.lit(turn)).alias("drawn"), F.col("node").alias("leader"), F.col("label").alias("of"))
    leaders = members.groupBy("key").agg(F.min(drawn).alias("first")).select("key", "first.leader", "first.of")
    pairs = members.join(leaders, "key").where("label <> of")
    return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def _shared_sizes(members: DataFrame, sets: DataFrame, save: _Steps) -> DataFrame:
    """(node, n, m): the size of every member's set, and how many of it another member has too."""
    some = sets.join(members.select("node").distinct(), "node", "left_semi")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in scan.chunks(batch.column(1)):
                node = np.repeat(batch.column(0).slice(lo, hi - lo).to_numpy(), np.diff(off) // 8)
                yield pa.RecordBatch.from_arrays([pa.array(raw.view(np.int64)), pa.array(node)], ["shingle", "node"])

    each = some.mapInArrow(unpack, "shingle long, node long").groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("to"))
    alone = each.where(F.col("node") == F.col("to")).groupBy("node").agg(F.count(F.lit(1)).alias("u"))
    size = some.select("node", (F.octet_length("own") / 8).cast("long").alias("n"))
    return save(size.join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("m")))


def _able(members: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Members, with n and m, that the bound allows a partner in one of their lists."""
    sized = members.join(sizes, "node")
    least = sized.groupBy("key").agg(F.min("n").alias("least")).where("least IS NOT NULL")
    closest = sized.join(least, "key").groupBy("node").agg(F.min("least").alias("least"))
    other = F.greatest(F.col("least"), F.col("m"))
    able = closest.join(sizes, "node").where(100 * F.col("m") >= percent * (F.col("n") + other - F.col("m"))).select("node")
    return sized.join(able, "node", "left_semi")


def _in_blocks(members: DataFrame, nodes: DataFrame, prefixes: DataFrame, matches: int, percent: int) -> DataFrame:
    """(key, i, j, list, pairs): nodes of a block, and places in that list of the pairs of different components that the
    signatures and the bound allow."""
    counts = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    shape = counts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all"))
    rows = members.join(shape, "key").withColumn("large", F.col("label") == F.col("top.label"))
    parts = F.greatest(F.lit(1), F.ceil(F.when(F.col("large"), F.col("top.c")).otherwise(F.col("all") - F.col("top.c")) / BLOCK))
    others = F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("top.c")) / BLOCK))
    larges = F.greatest(F.lit(1), F.ceil(F.col("top.c") / BLOCK))
    own = F.pmod(F.xxhash64("node", F.lit(5)), parts)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    # Blocks of the others meet each other (the lower first) and all blocks of the largest component (numbered from -1 down).
    meets_other = F.transform(upto(others), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    meets_large = F.transform(upto(larges), lambda k: F.struct(own.alias("i"), (-1 - k).alias("j")))
    from_large = F.transform(upto(others), lambda k: F.struct(k.alias("i"), (-1 - own).alias("j")))
    spots = F.when(F.col("large"), from_large).otherwise(F.concat(meets_other, meets_large))
    dealt = rows.select("key", "node", "label", "large", "n", "m", F.explode(spots).alias("spot"))
    dealt = dealt.select("key", "spot.i", "spot.j", "node", "label", "large", "n", "m")
    signed = dealt.join(nodes.select("node", "signature"), "node").join(prefixes.select("node", "keys"), "node")

    def compare(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        node, label, n, m = (table.column(c).to_numpy() for c in ("node", "label", "n", "m"))
        large = table.column("large").to_numpy(zero_copy_only=False)
        keys = table.column("keys").to_pylist()
        raw, _ = scan.utf8(table.column("signature"))
        values = raw.view(np.uint32).reshape(-1, COORDINATES)
        left, right = np.flatnonzero(~large), np.flatnonzero(large) if large.any() else np.flatnonzero(~large)
        out = []
        for x in left.tolist():
            common = np.minimum(m[right], m[x])
            fits = (label[right] != label[x]) & (100 * common >= percent * (n[right] + n[x] - common))
            some = right[fits]
            some = some[(values[some] == values[x]).sum(axis=1) >= matches]
            out += [(x, y) for y in some.tolist() if min(set(keys[x]) & set(keys[y])) == key]
        used, places = np.unique(np.array(out, np.int64).reshape(-1), return_inverse=True)
        row = [key, table.column("i")[0].as_py(), table.column("j")[0].as_py(), node[used].tolist(), places.astype("<u2").tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.table([pa.array([v] if out else [], k) for v, k in zip(row, kinds)], ["key", "i", "j", "list", "pairs"])

    return signed.groupBy("key", "i", "j").applyInArrow(compare, "key long, i long, j long, list array<long>, pairs binary")


def _overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Common elements of the sets of each pair, by products of the sets' incidence matrix, some columns at a time."""
    if len(pairs) < 32:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in pairs.tolist()], np.int64)
    column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(len(sets)), [len(own) for own in sets])
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total, width = np.zeros((len(sets), len(sets))), 4096
    edges = np.searchsorted(column, np.arange(0, int(shared.sum()) + width, width))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        held = np.zeros((len(sets), width), np.float32)
        held[owner[a:b], column[a:b] - k * width] = 1
        total += held @ held.T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def _confirmed_blocks(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of the pairs in blocks; the sets of a block's nodes meet there."""
    rows = blocks.select("key", "i", "j", "pairs", F.posexplode("list").alias("at", "node"))
    rows = rows.select("key", "i", "j", "at", "node", F.when(F.col("at") == 0, F.col("pairs")).alias("pairs")).join(sets, "node")

    def confirm(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        node = table.column("node").to_numpy()
        raw, off = scan.utf8(table.column("own"))
        own = [raw[a:b].view(np.uint64) for a, b in zip(off, off[1:])]
        pairs = np.frombuffer(table.column("pairs")[0].as_py(), "<u2").astype(np.int64).reshape(-1, 2)
        size = np.diff(off) // 8
        common = _overlaps(own, pairs)
        links = pairs[100 * common >= percent * (size[pairs[:, 0]] + size[pairs[:, 1]] - common)]
        ends = np.sort(node[links].reshape(-1, 2), axis=1)
        return pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return rows.groupBy("key", "i", "j").applyInArrow(confirm, "a long, b long").distinct()


def _judged(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = SIMILARITY_PERCENT,
    matches: int = MATCHES,
    rounds: int = LEADER_ROUNDS,
) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) of every row of ``docs``."""
    save = _Steps(docs.sparkSession)
    signed = save(_signed(docs, shingle))
    nodes = save(
        signed.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("least_id"),
            F.min(F.struct("doc_id", "text_key")).alias("of"),
            F.first("signature").alias("signature"),
        )
    )
    # Rows need their signature no more, the nodes have it.
    rows = save(signed.drop("signature"))
    discard(signed)
    prefixes = save(_prefixes(nodes, COORDINATES - matches + 1))
    postings = prefixes.select("node", "alone", F.explode("keys").alias("key"))
    labels = save(prefixes.select("node", F.col("node").alias("label")))
    members = save(_open(postings, labels))
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "of.doc_id", "of.text_key")
    wanted = save(wanted)
    read = save(_sets(docs, wanted, shingle))
    sets = _one_each(read, wanted, save)
    if sets is not read:
        discard(read)
    for turn in range(rounds):
        edges = _confirmed(save(_with_leader(members, turn)), nodes, sets, matches, percent, save)
        if edges.isEmpty():
            break
        labels = _united(labels, edges, save)
        members = save(_open(members.select("key", "node", "alone"), labels))
        if members.isEmpty():
            break
    if not members.isEmpty():
        able = _able(members, _shared_sizes(members, sets, save), percent)
        several = able.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        left = save(able.join(several, "key"))
        blocks = save(_in_blocks(left, nodes, prefixes, matches, percent))
        edges = save(_confirmed_blocks(blocks, sets, percent))
        labels = _united(labels, edges, save)
    for done in (sets, members, wanted):
        discard(done)
    named = nodes.select("node", "least_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of_node = save(named.join(least, "label").select("node", "component_id"))
    rows = rows.select("doc_id", "text_key", "n", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    return rows.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def components(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    return _judged(docs, **settings).drop("text_key")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that stand for their components, with all their columns."""
    kept = _judged(docs, **settings).where("kept").select(F.col("doc_id").alias("_kept"), F.col("text_key").alias("_text_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(kept["_kept"]) & (F.xxhash64(docs["text"].cast("string")) == kept["_text_key"])
    return docs.join(kept, same, "left_semi")
