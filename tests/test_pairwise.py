"""Metrics by tiles against the same over a table of pairs, and the number of blocks."""

import math

import numpy as np
import pytest

from pairloom.operators import bounds, measures, pairwise, temporal, tiles, truth
from pairloom.operators import geometry as geo


@pytest.fixture(scope="module")
def cloud(spark):
    """Points in 10 dimensions with exact and near copies far from the origin, and some without a label."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 10)) + 100
    x[40:60] = x[0]
    x[60:70] = x[1] + rng.normal(size=(10, 10)) * 1e-7
    rows = [(i, r.tolist(), r[:2].tolist(), r[2:4].tolist(), None if i % 11 == 0 else i % 4) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>, y array<double>, z array<double>, label int")


@pytest.fixture(autouse=True)
def small(monkeypatch):
    """Several tiles of several parts."""
    monkeypatch.setattr(tiles.blocks_of, "__defaults__", (80,))
    monkeypatch.setattr(tiles.dealt, "__defaults__", (80, False))
    monkeypatch.setattr(tiles.over, "__defaults__", (("x", "y"), 80, False))
    monkeypatch.setattr(tiles.Tile.parts, "__defaults__", (tiles.products, 7, 16))


def same(got, want, key=None):
    got, want = (sorted((r.asDict() for r in df.collect()), key=lambda r: tuple(r[c] for c in key or ())) for df in (got, want))
    assert len(got) == len(want) > 0
    for g, w in zip(got, want):
        assert g.keys() == w.keys()
        for c, v in w.items():
            assert g[c] == v or (isinstance(v, float) and math.isclose(g[c], v, rel_tol=1e-8, abs_tol=1e-9)), (c, g[c], v)


def test_sums_over_all_pairs(cloud):
    p = geo.pairs(cloud, extra="z")
    same(pairwise.stress(cloud), geo.stress(p))
    for alpha in (0, 1, 2):
        same(pairwise.weighted_stress(cloud, alpha, 0.1), geo.weighted_stress(p, alpha, 0.1))
    same(pairwise.block_residuals(cloud, 3.0, 4.0), geo.block_residuals(p, 3.0, 4.0))
    same(pairwise.log_distance_moments(cloud, 0.1), geo.log_distance_moments(p, 0.1))
    same(pairwise.weight_spread(cloud, 1, 0.1), geo.weight_spread(p, 1, 0.1))
    for theta, m in ((3.0, 4.0), (-1.0, 0.0), (1e9, 1e9)):
        same(pairwise.block_bounds(cloud, 1, 0.1, theta, m), bounds.block_bounds(p, 1, 0.1, theta, m))
        same(pairwise.slack_factors(cloud, 1, 0.1, theta, m), bounds.slack_factors(p, 1, 0.1, theta, m))
    same(pairwise.gaps(cloud, 1, 0.1), bounds.gaps(p, 1, 0.1))
    same(pairwise.log_lambda(cloud, 1, 0.1), bounds.log_lambda(p, 1, 0.1))


def test_sums_by_point_and_class(cloud):
    p = geo.pairs(cloud)
    same(pairwise.per_point_error(cloud), geo.per_point_error(p), "i")
    same(pairwise.gradient(cloud, 1, 0.1), geo.gradient(p, cloud, 1, 0.1), "i")
    same(pairwise.diagonal_hessian(cloud, 1, 0.1), geo.diagonal_hessian(p, cloud, 1, 0.1), "i")
    same(pairwise.class_means(cloud), geo.class_means(p), ("ca", "cb"))


def test_one_point_has_no_pair(cloud):
    one = cloud.limit(1)
    row = pairwise.stress(one).first()
    assert row.n_pairs == 0 and row.scale_invariant is None
    assert pairwise.per_point_error(one).count() == 0
    assert pairwise.block_bounds(one, 1, 0.1, 3.0, 4.0).first().near == 0.0


def test_what_is_shuffled_grows_with_the_points(cloud):
    """The number of times a point is sent is bounded until blocks are full, and so is the number of tiles."""
    assert [tiles.blocks_of(n, 512) for n in (0, 1, 512, 513, 10**5, 10**6, 1 << 21)] == [1, 1, 1, 2, 32, 32, 64]
    assert geo.pairs(cloud, 1).rdd.getNumPartitions() == 32 * 33 // 2
    assert geo.pairs(cloud, 1).count() == 150 * 149 // 2


def test_close_distances_keep_their_digits():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 16)) * 1000
    b = np.concatenate([a, a + 1e-6])
    assert np.allclose(tiles.products(a, b), tiles.differences(a, b), rtol=1e-9, atol=0)
    assert (np.diag(tiles.products(a, a)) == 0).all()


def test_medians_centring_hits_and_faults(cloud, monkeypatch):
    monkeypatch.setattr(pairwise, "MEDIAN_BANDS", 4)
    monkeypatch.setattr(pairwise, "MEDIAN_VALUES", 20)
    p = geo.pairs(cloud)
    same(pairwise.class_spread(cloud), geo.class_spread(p), ("label",))
    same(pairwise.whole_medians(cloud), geo.Classes(p).whole)
    same(pairwise.double_centred(cloud), geo.double_centred(p), ("i", "j"))
    distinct = cloud.filter("id < 40 or id >= 70")
    same(pairwise.neighborhood_hit(distinct, 7), geo.neighborhood_hit(geo.ranks(geo.pairs(distinct)), 7))
    near = lambda df: {(r.i, r.j, r["rank"]) for r in df.collect()}
    assert near(geo.nearest_by_blocks(cloud, 5, 30)) == near(geo.nearest(cloud, 5))
    read = lambda i, j, d: np.ma.array(np.where(i == 0, -d - 1, np.where(j == 149, np.nan, d)), mask=i == 1)
    assert {r.fault: r.n for r in pairwise.faults(cloud, read).collect()} == {"negative": 149, "missing": 148, "not a number": 147}


def test_overlap_looks_only_for_neighbours_that_are_there(spark, monkeypatch):
    """A k beyond every snapshot asks for no ranks, so nothing but the 3 nearest of each block leaves a task."""
    rng = np.random.default_rng(3)
    rows = [(t, n, float(rng.integers(6)), float(rng.integers(6))) for t in range(3) for n in range(60) if (t + n) % 9]
    p = spark.createDataFrame(rows, "t int, node long, x double, y double")
    asked = []
    found = temporal._candidates
    monkeypatch.setattr(temporal, "_candidates", lambda steps, k: asked.append(k) or found(steps, k, 16))
    got = {(r.t, r.k): (r.jaccard, r.note) for r in temporal.overlap_by_k(p, [3, 1_000_000]).collect()}
    assert asked == [3] and got[1, 1_000_000] == (None, "too few common nodes") and len(got) == 4
    at = {(t, n): (x, y) for t, n, x, y in rows}
    for t in (1, 2):
        both = [n for n in range(60) if (t, n) in at and (t - 1, n) in at]
        near = lambda n, s: set(sorted((m for m in both if m != n), key=lambda m: (math.dist(at[s, n], at[s, m]), m))[:3])  # noqa: B023, E731
        m = [len(near(n, t) & near(n, t - 1)) for n in both]
        assert math.isclose(got[t, 3][0], sum(v / (6 - v) for v in m) / len(m))


def test_counts_by_bands_come_once_a_task(spark):
    """Not once a slice: they are 2 MB each."""
    x = np.random.default_rng(2).normal(size=(9000, 3))
    p = spark.createDataFrame([(i, r.tolist(), r[:2].tolist(), i % 3) for i, r in enumerate(x)], "id long, x array<double>, y array<double>, label int")
    table = measures.row_table(p, 10)
    assert table.filter("bands IS NOT NULL").count() <= table.rdd.getNumPartitions() < 9000 // 466
    assert table.filter("i IS NOT NULL").count() == 9000


def test_nearest_by_blocks_meets_a_pair_of_blocks_once(cloud):
    """Blocks are few, so that a point is sent to few tiles."""
    near = lambda df: {(r.i, r.j, r["rank"], r.d_hi) for r in df.collect()}
    assert near(geo.nearest_by_blocks(cloud, 5, 2)) == near(geo.nearest(cloud, 5))
    plan = geo.nearest_by_blocks(cloud, 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert f"{tiles.FEW * (tiles.FEW + 1) // 2})" in plan and tiles.dealt(cloud, ["x"], 2, most=tiles.FEW).count() == 78


def test_rank_correlations_without_a_row_a_pair(cloud, monkeypatch):
    p = cloud.filter("id < 40 or id >= 70")
    want = geo.shepard(geo.pairs(p)).first()
    level = truth.ultrametric_spearman(geo.pairs(p)).first()
    monkeypatch.setattr(pairwise, "RANKED", 0)
    monkeypatch.setattr(pairwise, "RANK_BANDS", 1 << 22)  # few pairs share a band
    monkeypatch.setattr(geo, "pairs", None)  # not taken
    got = pairwise.shepard(p).first()
    assert math.isclose(got.pearson, want.pearson, rel_tol=1e-9) and math.isclose(got.spearman, want.spearman, rel_tol=1e-6)
    got = pairwise.ultrametric_spearman(p).first()
    assert got.n == level.n and math.isclose(got.spearman, level.spearman, abs_tol=1e-6)
