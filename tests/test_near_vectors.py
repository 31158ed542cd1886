"""Near-identical vectors against all pairs."""

import collections
import math

import numpy as np
import pytest

from verigauge.operators import near_vectors as NV

ROWS = "item_id long, v array<double>, n string, ball string, node string"


def brute(rows, cosine=0.999):
    able = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    scaled = {i: np.array(rows[i][1]) / np.abs(rows[i][1]).max() for i in able}
    unit = {i: v / np.linalg.norm(v) for i, v in scaled.items()}
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in able:
        for j in able:
            if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] > cosine:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (item, _) in enumerate(rows):
        if item is not None:
            least[root(i)] = min(item, least.get(root(i), item))
    return collections.Counter((item, links[i], least.get(root(i))) for i, (item, _) in enumerate(rows))


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], ROWS)
    return collections.Counter((r.item, r.n_links, r.class_id) for r in NV.near_classes(df, "v", "item_id", **options).collect())


def crowd(rng, centre, spread, n):
    return [(centre + spread * rng.standard_normal(len(centre)) / math.sqrt(len(centre))).tolist() for _ in range(n)]


def test_all_pairs(spark):
    rng = np.random.default_rng(4)
    c = rng.standard_normal((3, 8))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    vectors = [rng.standard_normal(8).tolist() for _ in range(150)]
    # a third is near-equal; a crowd about as wide as the limit; a chain; equal and scaled vectors
    vectors += crowd(rng, c[0], 0.004, 150) + crowd(rng, c[1], 0.03, 120) + crowd(rng, c[2], 0.06, 60)
    vectors += [(c[0] * math.cos(t) + c[1] * math.sin(t)).tolist() for t in np.arange(0, 0.5, 0.03)]
    vectors += [vectors[0]] * 20 + [(3 * np.array(vectors[1])).tolist()] * 3 + [(-np.array(vectors[1])).tolist()]
    vectors += [None, [], [0.0] * 8, [float("nan")] * 8, [float("inf"), *[1.0] * 7], [None, *[1.0] * 7], [1e-200] * 8, [1e200] * 8, [1.0] * 8, [1.0] * 3, [2.0] * 3]
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(None, vectors[0]), (5, vectors[5]), (5, vectors[5]), (None, None)]
    rng.shuffle(rows)
    rows = [(None if i is None else int(i), v) for i, v in rows]
    want = brute(rows)
    assert got(spark, rows) == want
    # crowds become cores, and cells are cut into blocks
    assert got(spark, rows, crowd=20, least_core=5, block=16) == want


def test_crowds_cost_no_pairs(spark):
    """Near-equal vectors, a third of all: their cores link as wholes, no member is compared."""
    rng = np.random.default_rng(1)
    centre = rng.standard_normal(16)
    vectors = crowd(rng, centre / np.linalg.norm(centre), 0.002, 2000) + [rng.standard_normal(16).tolist() for _ in range(4000)]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], ROWS)
    out = NV.near_classes(df, "v", "item_id", crowd=100)
    found = {r.item: (r.n_links, r.class_id) for r in out.collect()}
    assert all(found[i] == (1999, 0) for i in range(2000))
    assert sum(found[i][0] for i in range(2000, 6000)) % 2 == 0


def test_empty(spark):
    assert NV.near_classes(spark.createDataFrame([], ROWS), "v", "item_id").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3])
def test_partners_visit_the_home(n):
    """Whatever lies within the limit visits the cell that a vector is at home in."""
    rng = np.random.default_rng(n)
    theta = math.acos(0.999)
    x = rng.standard_normal((500, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.9 * theta * (d := rng.standard_normal(x.shape)) / np.linalg.norm(d, axis=1, keepdims=True)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    gap = np.abs(np.arccos(x @ NV.anchors(12, n).T) - np.arccos(y @ NV.anchors(12, n).T))
    assert ((x * y).sum(axis=1) > 0.999).all() and (gap < theta).all()


@pytest.mark.parametrize("dim", [1, 2, 3, 8, 12, 64])
def test_visits_are_whole_and_few(dim):
    """Every partner visits the home of a vector, and a vector visits few cells, however many vectors there are."""
    import pyarrow as pa

    rng = np.random.default_rng(dim)
    theta = math.acos(0.999)
    x = rng.standard_normal((3000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + 0.99 * theta * (d := rng.standard_normal(x.shape)) / np.linalg.norm(d, axis=1, keepdims=True)
    y /= np.linalg.norm(y, axis=1, keepdims=True)

    def places(v):
        batch = pa.RecordBatch.from_arrays([pa.array(v.tolist(), pa.list_(pa.float64())), pa.array(np.zeros(len(v)))], ["v", "r"])
        out = pa.Table.from_batches(NV._visits(theta)([batch]))
        return out.column("home").to_pylist(), out.column("cells").to_pylist()

    (home, mine), (_, theirs) = places(x), places(y)
    assert all(h in m and h in t for h, m, t in zip(home, mine, theirs, strict=True))
    assert len(set(home)) > min(2 ** dim, 300) // 2
    assert np.mean([len(m) for m in mine]) < 6
