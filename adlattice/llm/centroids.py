"""Clustering of embeddings around integer centroids by scalar lookup tables.

Every component becomes an integer. Vectors are laid out once in blocks of up to ``BLOCK`` rows; a block lists, for each
dimension, the integers that occur in it, and holds each component as its place in that list. In every round a task
tabulates, for each dimension, occurring integer and centroid, the squared difference; the distances of a block are then
gathers from that table and their sums. Tables are as large as a block allows, whatever the size of the corpus. From a round, at most
K x (components + 1) partial sums of each task meet in Spark, and their totals reach the driver: K centroids.

Defined results: vectors that are null, have another number of components, or hold null or non-finite components are left out. A null
vec_id is clustered and comes last among the first centroids. Vectors with one vec_id are different vectors; as first centroids they
stand in the order of their components. With fewer vectors than K there are as many centroids. Products beyond 2^27 in size count as
2^27, so that a distance fits a long; an inertia beyond a long is the greatest long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adlattice.session import fresh_path

CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
COMPONENTS = 64
SEED = 3
BLOCK = 4096
LARGEST = 1 << 27
LONG_MAX = (1 << 63) - 1

BLOCKS = "ids binary, nulls binary, sizes binary, values binary, codes binary"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the kept vectors as integers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = vectors.where((F.size("embedding") == components) & finite)
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST))))
    return kept.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: whole(x).cast("int")).alias("v"))


def first_centroids(ints: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``; every task hands on k rows at most."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = ints.orderBy(drawn.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def _block(ids: pa.Array, v: np.ndarray) -> list[bytes]:
    columns = [np.unique(v[:, d], return_inverse=True) for d in range(v.shape[1])]
    codes = np.stack([c[1] for c in columns]).astype("<u2") if columns else np.zeros((0, len(v)), "<u2")
    sizes = np.array([len(c[0]) for c in columns], "<i4")
    values = np.concatenate([c[0] for c in columns]).astype("<i4") if columns else np.zeros(0, "<i4")
    null = np.array(ids.is_null().to_numpy(zero_copy_only=False), np.uint8)
    return [ids.fill_null(0).to_numpy().astype("<i8").tobytes(), null.tobytes(), sizes.tobytes(), values.tobytes(), codes.tobytes()]


def blocks(ints: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Blocks of vectors with their occurring integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), components)
            for lo in range(0, len(lists), BLOCK):
                row = _block(batch.column(0).slice(lo, BLOCK), flat[lo : lo + BLOCK])
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], BLOCKS.replace(",", "").split()[::2])

    return ints.mapInArrow(run, BLOCKS)


def distances(row: dict, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centroids) of a block: table entries of every dimension, added up."""
    sizes, values = np.frombuffer(row["sizes"], "<i4"), np.frombuffer(row["values"], "<i4").astype(np.int64)
    codes = np.frombuffer(row["codes"], "<u2").reshape(len(sizes), -1)
    table = values[:, None] - centroids.T[np.repeat(np.arange(len(sizes)), sizes)]
    table *= table
    total, base = np.zeros((codes.shape[1], len(centroids)), np.int64), 0
    for d, size in enumerate(sizes.tolist()):
        total += table[base : base + size].take(codes[d], axis=0)
        base += size
    return total


def _vectors(row: dict) -> np.ndarray:
    """The integers of a block (components x rows)."""
    sizes, values = np.frombuffer(row["sizes"], "<i4"), np.frombuffer(row["values"], "<i4")
    codes = np.frombuffer(row["codes"], "<u2").reshape(len(sizes), -1).astype(np.int64)
    return values[codes + (np.cumsum(sizes) - sizes)[:, None]]


def cluster_sums(laid: DataFrame, centroids: np.ndarray, distance: bool = False) -> dict[int, tuple[int, list[int]]]:
    """(rows, sums of components) of every cluster that has rows; with ``distance`` the sum of distances instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(centroids), np.int64)
        # Sums in two parts, of multiples of 2^20 and the rest: a task's sums stay in 64 bits.
        high, low = (np.zeros((len(centroids), 1 if distance else centroids.shape[1]), np.int64) for _ in range(2))
        for batch in batches:
            for row in batch.to_pylist():
                d = distances(row, centroids)
                nearest = d.argmin(axis=1)
                what = d.min(axis=1)[None] if distance else _vectors(row).astype(np.int64)
                count += np.bincount(nearest, minlength=len(centroids))
                for c in range(len(centroids)):
                    own = what[:, nearest == c]
                    high[c] += (own >> 20).sum(axis=1)
                    low[c] += (own & ((1 << 20) - 1)).sum(axis=1)
        cluster = np.repeat(np.arange(len(centroids)), high.shape[1])
        place = np.tile(np.arange(high.shape[1]), len(centroids))
        columns = [cluster, place, np.repeat(count, high.shape[1]), high.reshape(-1), low.reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cluster", "place", "n", "high", "low"])

    parts = laid.mapInArrow(run, "cluster long, place long, n long, high long, low long").where("n > 0")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(parts.groupBy("cluster", "place").agg(*wide).collect(), key=lambda r: (r["cluster"], r["place"])):
        out.setdefault(r["cluster"], (int(r["n"]), []))[1].append((int(r["high"]) << 20) + int(r["low"]))
    return out


def centroid_name(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def assigned(laid: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Every vector's cluster and distance, with the inertias and the centroid's digest."""
    sums = cluster_sums(laid, centroids, distance=True)
    own = [min(sums[c][1][0], LONG_MAX) if c in sums else 0 for c in range(len(centroids))]
    inertia = np.array(own, np.int64)
    every = min(sum(s[1][0] for s in sums.values()), LONG_MAX)
    names = pa.array([centroid_name(c) for c in centroids], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                d = distances(row, centroids)
                nearest = d.argmin(axis=1)
                ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=np.frombuffer(row["nulls"], np.uint8) > 0)
                columns = [ids, pa.array(nearest.astype(np.int32)), pa.array(d.min(axis=1)), pa.array(inertia[nearest])]
                columns += [pa.array(np.full(len(ids), every, np.int64)), names.take(pa.array(nearest))]
                yield pa.RecordBatch.from_arrays(columns, RESULT.replace(",", "").split()[::2])

    return laid.mapInArrow(run, RESULT)


def cluster(
    vectors: DataFrame,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """Clusters of ``vectors`` (vec_id, embedding) after so many rounds."""
    spark = vectors.sparkSession
    ints = integers(vectors, components, scale)
    centroids = first_centroids(ints, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    path = fresh_path(spark, "centroids")
    blocks(ints, components).write.option("compression", "zstd").parquet(path)
    laid = spark.read.parquet(path)
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (n, total) in cluster_sums(laid, centroids).items():
            moved[c] = [t // n for t in total]
        if (moved == centroids).all():
            break
        centroids = moved
    return assigned(laid, centroids)


def cluster_sql(k: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> str:
    """The same in the SQL of the test database: one pair of tables for each round."""
    parts = [
        f"""ints AS MATERIALIZED (
  SELECT vec_id, sha256('{seed}:' || vec_id) AS drawn, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {components})""",
        f"""c0 AS MATERIALIZED (
  SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS d
  FROM (SELECT v, row_number() OVER (ORDER BY drawn, v) - 1 AS c FROM ints) WHERE c < {k})""",
        "cells AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM ints)",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
  SELECT vec_id, arg_min(c, (dist, c)) AS c, min(dist) AS dist
  FROM (SELECT vec_id, c, sum((cells.x - c{r}.x) * (cells.x - c{r}.x))::BIGINT AS dist
        FROM cells JOIN c{r} USING (d) GROUP BY vec_id, c) GROUP BY vec_id)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT old.c, old.d, coalesce(new.x, old.x) AS x FROM c{r} AS old LEFT JOIN (
    SELECT a{r}.c, d, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
    FROM cells JOIN a{r} USING (vec_id) GROUP BY a{r}.c, d) AS new ON old.c = new.c AND old.d = new.d)"""
            )
    return f"""WITH {", ".join(parts)},
names AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY c),
own AS (SELECT c, sum(dist)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, dist AS distance, cluster_inertia,
  (SELECT sum(dist)::BIGINT FROM a{rounds}) AS inertia, centroid_sha256
FROM a{rounds} JOIN own USING (c) JOIN names USING (c)"""
