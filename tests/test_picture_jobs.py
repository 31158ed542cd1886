"""The grid, view and sweep queries put every picture through the kernels of every cell."""

import pyarrow.parquet as pq
import pytest

from verigauge.operators import grids as G
from verigauge.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()


@pytest.fixture
def vectors():
    return pq.read_table(f"{SF}/embeddings.parquet").num_rows


def counts(rows):
    return {(r.key, r.severity): (r.pictures, r.scored, r.failed) for r in rows}


def whole(spark, name, conditions, n):
    want = {(c.key, c.severity): (n, 0, n) if "webp" in c.key else (n, n, 0) for c in conditions}
    assert counts(QUERIES[name](spark, SF).collect()) == want


def test_graded_grid(spark, vectors):
    whole(spark, "d2_graded_grid", G.graded_grid(), vectors)


def test_official_grid(spark, vectors):
    whole(spark, "d3_official_grid", G.official_grid(), vectors)


def test_evaluation_grid(spark, vectors):
    whole(spark, "d4_evaluation_grid", G.all_conditions(), vectors)


def test_view_features(spark, vectors):
    rows = QUERIES["d11_view_features"](spark, SF).collect()
    assert sorted((r.view_id, r.n, r.featured, r.feature_dim) for r in rows) == [(i, vectors, vectors, 3) for i in range(4)]


def test_image_sweep(spark, vectors):
    """Every cell has its figures, and the kernels make them: no two families rank the pictures alike to 3 places everywhere."""
    rows = {(r.key, r.severity): r for r in QUERIES["d13_image_sweep"](spark, SF).collect()}
    grid = {(c.key, c.severity) for c in G.official_grid()}
    assert set(rows) == grid | {("faded", i) for i in range(5)}
    assert all(r.n_pos + r.n_neg == vectors and r.near is not None for r in rows.values())
    told = [k for k in grid if k[0] not in ("off_noise", "off_jitter")]
    assert len({(rows[k].accuracy, rows[k].auc) for k in told}) > len(told) // 2
