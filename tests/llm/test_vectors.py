"""Centroids and links of embeddings: against plain numpy over all pairs."""

import hashlib

import numpy as np
import pytest

from adlattice.llm import centroids, collisions

VECTORS = "vec_id long, embedding array<float>, label int, node long, v string, core int, `key` string"


def frame(spark, rows, schema=VECTORS):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, "y") for i, v in rows], schema)


def group(r, centre, n, spread):
    out = centre + spread * r.standard_normal((n, len(centre)))
    return [x.tolist() for x in out]


def odd_rows():
    nan, inf = float("nan"), float("inf")
    return [(900, None), (901, []), (902, [None] + [1.0] * 63), (903, [nan] + [1.0] * 63), (904, [inf] * 64), (905, [0.0] * 64), (None, None)]


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(5)
    vectors = [x.tolist() for x in r.standard_normal((150, 64))]
    one, two = r.standard_normal(64), r.standard_normal(64)
    vectors += group(r, one, 90, 0.08) + group(r, one, 40, 0.2) + group(r, two, 60, 0.16) + group(r, (one + two) / 2, 20, 0.2)
    vectors += group(r, r.standard_normal(64), 30, 0.23)
    vectors += [vectors[0]] * 3 + [vectors[160]] * 5 + [(3.0 * np.array(vectors[1])).tolist(), (-np.array(vectors[2])).tolist()]
    vectors += [x.tolist() for x in r.standard_normal((4, 3))] + [[1.0, 2.0, 3.0], [2.0, 4.0, 6.1], [1e30, 1e30, 1e30], [1e-30, 1e-30, 1.1e-30]]
    listed = [(int(i), v) for i, v in zip(r.permutation(len(vectors)), vectors)]
    return [*listed, *odd_rows(), listed[7], (listed[8][0], listed[9][1]), (None, listed[165][1]), (None, listed[20][1])]


# ---- links ----


def brute_links(rows, cosine=0.95):
    usable = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    vectors = [np.float32(v).astype(float) if usable(v) else None for _, v in rows]
    linked = [[] for _ in rows]
    for i, x in enumerate(vectors):
        for j, y in enumerate(vectors):
            if i != j and x is not None and y is not None and len(x) == len(y):
                if (x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())) @ (y / np.abs(y).max() / np.linalg.norm(y / np.abs(y).max())) >= cosine:
                    linked[i].append(j)
    out, seen = {}, set()
    for i in range(len(rows)):
        if i in seen:
            continue
        stack, own = [i], {i}
        while stack:
            for j in linked[stack.pop()]:
                if j not in own:
                    own.add(j)
                    stack.append(j)
        seen |= own
        ids = [rows[j][0] for j in own if rows[j][0] is not None]
        for j in own:
            out[j] = (rows[j][0], len(linked[j]), min(ids) if ids else None, rows[j][0] == (min(ids) if ids else None))
    return sorted(map(repr, out.values()))


@pytest.mark.parametrize("crowded,block,companions", [(128, 1024, 4), (8, 8, 1000), (10**6, 8, 64)])
def test_links_equal_brute_force(spark, rows, crowded, block, companions):
    got = collisions.linked(frame(spark, rows), recall=1 - 1e-9, crowded=crowded, block=block, companions=companions)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_links(rows)


def test_links_of_empty_and_odd_tables(spark):
    assert collisions.linked(frame(spark, [])).collect() == []
    got = {r["vec_id"]: tuple(r)[1:] for r in collisions.linked(frame(spark, odd_rows())).collect()}
    assert got == {i: (0, i, True) for i, _ in odd_rows()}


def test_recall_near_the_threshold(spark):
    """Pairs with a cosine just above the threshold: 1,500 of them, none of which brute force may know alone."""
    r = np.random.default_rng(8)
    rows = []
    for k in range(1500):
        x = r.standard_normal(64)
        x /= np.linalg.norm(x)
        y = r.standard_normal(64)
        y -= (y @ x) * x
        c = 0.9505 + 0.01 * r.random()
        rows += [(2 * k, x.tolist()), (2 * k + 1, (c * x + np.sqrt(1 - c * c) * y / np.linalg.norm(y)).tolist())]
    got = {r["vec_id"]: r["n_links"] for r in collisions.linked(frame(spark, rows)).collect()}
    assert sum(got[2 * k] >= 1 for k in range(1500)) >= 1498


def test_calibration():
    for nodes in (1, 1000, 10**6, 10**9):
        bits = collisions.bits_for(nodes)
        lines = collisions.lines_for(0.95, bits)
        p = collisions.chance(0.95, bits)
        draws = np.random.default_rng(1).binomial(lines, p, 200_000)
        assert (draws < collisions.COLLISIONS).mean() < 1e-4
        assert nodes * collisions.chance(0.0, bits) <= collisions.COMPANIONS + 1e-9
    x, y = np.eye(64)[:1], 0.95 * np.eye(64)[:1] + np.sqrt(1 - 0.95**2) * np.eye(64)[1:2]
    (a, b), (v, w) = zip(collisions.places(x, 3, 4000), collisions.places(y, 3, 4000)), (0, 0)
    same = (a[0] == a[1]) & (np.abs(b[0] - b[1]) <= collisions.WINDOW)
    assert abs(same.mean() - collisions.chance(0.95, 3)) < 0.03


def test_window_pairs():
    run, value = np.array([0, 0, 0, 0, 1, 1]), np.array([0.0, 0.1, 0.2, 0.9, 0.0, 0.05])
    core, side = np.array([5, 5, 0, 0, 0, 0]), np.zeros(6, int)
    pairs = lambda *a: sorted(zip(*(p.tolist() for p in collisions.window_pairs(run, value, *a, 0.15))))
    assert pairs(core, side) == [(1, 2), (4, 5)]
    assert pairs(np.zeros(6, int), np.array([1, 2, 2, 1, 1, 1])) == [(0, 1)]


# ---- centroids ----


def brute_clusters(rows, k=8, rounds=10):
    usable = lambda v: v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if usable(v)]
    draw = lambda i: "~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (draw(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for c in range(len(centres)):
            own = [v for (_, v), n in zip(kept, of) if n == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own)]
    last = [near(v) for _, v in kept]
    own = [sum(d for d, n in last if n == c) for c in range(len(centres))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(repr((i, n, d, own[n], sum(own), names[n])) for (i, _), (d, n) in zip(kept, last))


def test_clusters_equal_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(centroids, "BLOCK", 50)
    got = centroids.cluster(frame(spark, rows).repartition(3))
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_clusters(rows)


def test_clusters_of_few_vectors(spark):
    assert centroids.cluster(frame(spark, [])).collect() == []
    assert centroids.cluster(frame(spark, odd_rows()[:5])).collect() == []
    same = [(k, [0.5] * 64) for k in range(3)] + [(3, [0.5] * 64), (3, [-0.25] * 64), (None, [0.25] * 64), (7, [0.0] * 64)]
    got = centroids.cluster(frame(spark, same))
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_clusters(same)


def test_clusters_of_huge_components(spark):
    rows = [(k, [1e30 if k % 2 else -1e30] * 64) for k in range(300)]
    got = centroids.cluster(frame(spark, rows), k=1).collect()
    assert len(got) == 300 and {r["inertia"] for r in got} == {centroids.LONG_MAX}
    assert {r["distance"] for r in got} == {64 << 54}
    assert {r["distance"] for r in centroids.cluster(frame(spark, rows), k=2).collect()} == {0}


def test_distances_are_exact():
    r = np.random.default_rng(2)
    v, c = r.integers(-500, 500, (70, 5)), r.integers(-500, 500, (3, 5))
    import pyarrow as pa

    row = dict(zip(("ids", "nulls", "sizes", "values", "codes"), centroids._block(pa.array(range(70)), v)))
    assert np.array_equal(centroids.distances(row, c), ((v[:, None] - c[None]) ** 2).sum(axis=2))
    assert np.array_equal(centroids._vectors(row).T, v)
