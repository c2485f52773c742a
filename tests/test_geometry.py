import numpy as np
import pytest

from pairloom.operators import geometry as geo
from pairloom.sources import generated, registry  # noqa: F401

POINT = "id long, x array<double>, y array<double>, label int"


def frame(spark, x, y, label=None):
    label = [None] * len(x) if label is None else label
    return spark.createDataFrame([(i, list(map(float, np.atleast_1d(a))), list(map(float, np.atleast_1d(b))), c) for i, (a, b, c) in enumerate(zip(x, y, label))], POINT)


@pytest.fixture
def cloud():
    rng = np.random.default_rng(0)
    return rng.normal(size=(40, 5)), rng.normal(size=(40, 2)), [int(i % 3) for i in range(40)]


def distances(a):
    return np.sqrt(((a[:, None] - a[None]) ** 2).sum(-1))


def test_pairs_cover_all_blocks(spark, cloud):
    p = geo.pairs(frame(spark, *cloud), block=7).collect()
    d, e = distances(cloud[0]), distances(cloud[1])
    assert len(p) == len({(r.i, r.j) for r in p}) == 40 * 39 // 2
    assert all(r.i < r.j and abs(r.d_hi - d[r.i, r.j]) < 1e-12 and abs(r.d_lo - e[r.i, r.j]) < 1e-12 and (r.ci, r.cj) == (r.i % 3, r.j % 3) for r in p)


def test_one_pass_agrees_with_windows(spark, cloud):
    f = frame(spark, *cloud)
    one = geo.profile_metrics(geo.profile(f, (3, 5)), (3, 5), 5).first().asDict()
    p = geo.pairs(f)
    r = geo.ranks(p)
    slow = geo.stress(p).crossJoin(geo.trust_continuity(r, 5)).crossJoin(geo.overlap(r, 5)).crossJoin(geo.neighborhood_hit(r, 5)).crossJoin(geo.distance_correlation(p)).crossJoin(geo.silhouette(p)).crossJoin(geo.auc_rnx(geo.qnx_curve(r))).first().asDict()
    assert all(abs(one[k] - slow[k]) < 1e-9 for k in one if k != "k")
    a, b = geo.nearest(f, 4).collect(), geo.knn(p, 4).select("i", "j", "rank", "d_hi").collect()
    assert sorted((x.i, x.j, x.rank) for x in a) == sorted((x.i, x.j, x.rank) for x in b)


def test_unlabelled_and_single_classes_agree_in_both_forms(spark, cloud, monkeypatch):
    """Null, negative and single labels, and points in one place, with and without broadcast coordinates."""
    x, y, _ = cloud
    flat = y.copy()
    flat[:6] = 0.0
    some = [None if i % 4 == 0 else i % 3 - 1 for i in range(40)]
    for label, low in ((some, y), ([5] * 40, y), ([None] * 40, y), (list(range(40)), y), ([i // 6 for i in range(40)], flat), ([0] * 39 + [1], y)):
        f = frame(spark, x, low, label)
        one = geo.profile_metrics(geo.profile(f, (5,)), (5,), 5).first()
        p = geo.pairs(f, block=9)
        sil, hit = geo.silhouette(p).first().silhouette, geo.neighborhood_hit(geo.ranks(p), 5).first().hit
        assert (one.silhouette is None) == (sil is None) and (sil is None or abs(one.silhouette - sil) < 1e-9)
        assert (one.hit is None) == (hit is None) and (hit is None or abs(one.hit - hit) < 1e-9)
    monkeypatch.setattr(geo, "BROADCAST_BYTES", 0)
    small = geo.evaluate(frame(spark, x, y, some), 5, (5, 9)).first().asDict()
    monkeypatch.undo()
    large = geo.evaluate(frame(spark, x, y, some), 5, (5, 9)).first().asDict()
    assert set(small) == set(large) and all((small[k] is None) == (large[k] is None) and (small[k] is None or abs(small[k] - large[k]) < 1e-9) for k in small)


def test_class_geometry_by_hand(spark):
    # Classes at 0 and 1, at 10 and 12, at 100 and 104 of a line; the map stretches the last.
    x, y, c = [0.0, 1.0, 10.0, 12.0, 100.0, 104.0], [0.0, 1.0, 10.0, 12.0, 100.0, 108.0], [0, 0, 1, 1, 2, 2]
    p = geo.pairs(frame(spark, x, y, c))
    d, e = (np.median([abs(a - b) for i, a in enumerate(v) for b in v[:i]]) for v in (x, y))
    want = np.median([abs(np.log((lo / e) / (hi / d))) for hi, lo in ((1, 1), (2, 2), (4, 8))])
    assert abs(geo.lie_factor(p).first()[0] - want) < 1e-12
    assert geo.centroid_spearman(p).first()[0] == 1 and geo.spread_spearman(p).first()[0] == 1
    assert geo.class_neighbours_kept(p).first()[0] is None and geo.class_neighbours_kept(p, 2).first()[0] == 1
    rows = {r.question: r for r in geo.discovery(p).collect()}
    assert rows["nearest_class_pair"].true_answer == "0|1" and rows["nearest_class_pair"].n_candidates == 3 and rows["most_dispersed_class"].pred_answer == "2"
    two = geo.pairs(frame(spark, x[:4], y[:4], c[:4]))
    assert geo.lie_factor(two).first()[0] is None and geo.centroid_spearman(two).first()[0] is None
    assert {r.note for r in geo.discovery(two).collect()} == {"insufficient_classes_or_no_labels"}
    tie = geo.pairs(frame(spark, [0.0, 2.0, 10.0, 12.0, 20.0, 22.0], y, c))
    assert {r.question: r.tie_in_truth for r in geo.discovery(tie).collect()} == {"nearest_class_pair": True, "most_dispersed_class": True}


def test_properties_by_hand(spark):
    x = np.random.default_rng(5).random((60, 2))
    d = distances(x)
    away = d + np.diag([np.inf] * 60)
    near = np.sort(away, axis=1)
    far = d.max(1)
    contrast = np.median((far - near[:, 0]) / near[:, 0])
    mle = np.mean(1 / np.mean(np.log(near[:, 9:10] / near[:, :9]), axis=1))
    mu = np.sort(near[:, 1] / near[:, 0])
    mu = mu[mu > 1]
    keep = round(0.9 * len(mu))
    a, b = np.log(mu[:keep]), -np.log(1 - np.arange(1, keep + 1) / len(mu))
    r = geo.properties(frame(spark, x, x, [i % 3 for i in range(60)])).first()
    assert abs(r.relative_contrast - contrast) < 1e-9 and abs(r.id_mle - mle) < 1e-9 and abs(r.id_twonn - (a * b).sum() / (a * a).sum()) < 1e-9
    assert geo.two_nn(geo.nearest(frame(spark, x[:8], x[:8]), 2), 0.9).first()[0] is None
    assert abs(geo.estimate_eps(frame(spark, x, x), 5, 0.1).first().eps - np.quantile(near[:, 4], 0.1)) < 1e-12
    with pytest.raises(Exception, match="no distance"):
        geo.estimate_eps(frame(spark, np.zeros((9, 2)), np.zeros((9, 2))), 5, 0.1).collect()


def test_standardised_columns_without_spread_are_0(spark):
    got = {(r.id, r.k): r.z for r in geo.standardised(frame(spark, [[1.0, 7.0], [3.0, 7.0]], [0.0, 0.0])).collect()}
    assert got == {(0, 0): -1.0, (1, 0): 1.0, (0, 1): 0.0, (1, 1): 0.0}


def test_ranks_and_pairs_meet_by_bands_and_blocks(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=300).round(1), [50.0]])
    r = geo.global_rank(spark.createDataFrame([(float(a),) for a in v], "v double"), "v", "rank", bands=7).collect()
    order = np.sort(v)
    assert all(x["rank"] == (np.searchsorted(order, x.v) + np.searchsorted(order, x.v, side="right") + 1) / 2 for x in r) and len(r) == 301
    rows = [(t, i, float(i * t)) for t, n in ((1, 30), (2, 1), (3, 7)) for i in range(n)]
    got = sorted((x.t, min(x.i, x.i2), max(x.i, x.i2)) for x in geo.within(spark.createDataFrame(rows, "t long, i long, v double"), "t", "i", "v", block=4).collect())
    assert got == sorted((t, i, j) for t, n in ((1, 30), (3, 7)) for i in range(n) for j in range(i + 1, n))


def test_diagonal_hessian_agrees_with_differences(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(9, 3)), rng.normal(size=(9, 2))
    d = distances(x)
    w = (d + 0.1) ** -1.0
    stress = lambda y: (w * (d - distances(y)) ** 2)[np.triu_indices(9, 1)].sum()
    f = frame(spark, x, y)
    got = {r.i: (r.hx, r.hy) for r in geo.diagonal_hessian(geo.pairs(f), f, 1, 0.1).collect()}
    for i in range(9):
        for k in (0, 1):
            step = np.zeros_like(y)
            step[i, k] = 1e-4
            assert abs(got[i][k] - (stress(y + step) + stress(y - step) - 2 * stress(y)) / 1e-8) < 1e-2 * max(1, abs(got[i][k]))


def test_a_map_equal_to_its_input_is_perfect(spark, cloud):
    f = frame(spark, cloud[1], cloud[1], cloud[2])
    m = geo.evaluate(f, 5).first()
    assert abs(m.scale_invariant) < 1e-12 and m.kruskal == 0 and m.trustworthiness == m.continuity == m.jaccard == 1 and abs(m.dcor - 1) < 1e-9 and abs(m.auc_rnx - 1) < 1e-12


def test_published_four_point_example(spark):
    d = {(0, 1): 1, (0, 2): 2, (0, 3): 5, (1, 2): 3, (1, 3): 4, (2, 3): 6}
    for y, scale_invariant, kruskal, blocks in (([0, 1, 3, 4], 0.28543956, 0.85146932, (0, 2, 27)), ([0, 1, 2, 5], 0.11911303, 0.48181206, (0, 4, 9))):
        p = spark.createDataFrame([(i, j, float(v), float(abs(y[i] - y[j])), None, None) for (i, j), v in d.items()], "i long, j long, d_hi double, d_lo double, ci int, cj int")
        s, b = geo.stress(p).first(), geo.block_residuals(p, 1.5, 3.5).first()
        assert abs(s.scale_invariant - scale_invariant) < 1e-7 and abs(s.kruskal - kruskal) < 1e-7 and (b.near, b.mid, b.far) == blocks
        assert abs(geo.weighted_stress(p, 1, 0.5).first().sigma - (4.935908 if y[2] == 3 else 2.527473)) < 1e-5


def test_constant_and_tiny_inputs_give_null(spark):
    f = frame(spark, [0.0, 0.0, 0.0], [1.0, 1.0, 1.0])
    p = geo.pairs(f)
    s = geo.stress(p).first()
    assert s.scale_invariant is None and s.kruskal is None
    assert geo.trust_continuity(geo.ranks(p), 7).first().trustworthiness is None


def test_grid_and_dimension(spark):
    g = registry.load(spark, "grid", side=12).withColumn("y", __import__("pyspark").sql.functions.slice("x", 1, 2))
    near = geo.nearest(g, 1).collect()
    assert {r.d_hi for r in near} == {1.0}
    line = frame(spark, [[float(v)] for v in np.random.default_rng(1).random(300)], np.zeros((300, 2)))
    assert abs(geo.properties(line).first().id_mle - 1) < 0.25


def test_nearest_by_blocks_and_checks(spark, cloud):
    x = np.round(cloud[0][:, :1], 1)  # many ties
    f = frame(spark, x, cloud[1])
    a, b = geo.nearest(f, 4).collect(), geo.nearest_by_blocks(f, 4, block=7).collect()
    assert sorted((r.i, r.j, r.rank) for r in a) == sorted((r.i, r.j, r.rank) for r in b) and len(a) == 160
    p = geo.pairs(f)
    assert geo.checked(p).count() == p.count()
    with pytest.raises(Exception, match="negative"):
        geo.checked(p.withColumn("d_hi", -p["d_hi"] - 1)).collect()
    m = geo.log_distance_moments(p.withColumn("d_hi", p["d_hi"] * 0 + 2), 0.0).first()
    assert (round(m.mean, 9), m.sd, m.skew, m.kurtosis) == (round(float(np.log(2)), 9), 0.0, 0.0, 0.0)


def test_points_with_known_truth(spark):
    pair = registry.load(spark, "density_pair", n=2000)
    assert {r["label"]: r["count"] for r in pair.groupBy("label").count().collect()} == {0: 1800, 1: 200}
    hole = registry.load(spark, "swiss_roll_hole", n=500)
    assert hole.count() == 500 and hole.filter("x[1] / 21 between 0.31 and 0.69 and label between 4 and 5").count() == 0
    c = geo.centroids(registry.load(spark, "planar_clusters", n=1200).withColumnRenamed("x", "y"), dims=10).collect()
    assert len(c) == 6 and all(abs(v) < 1 for r in c for v in r.c[2:])


def test_exact_median(spark):
    rng = np.random.default_rng(2)
    for n, bands, most in ((1, 8, 0), (2, 8, 1), (999, 8, 5), (1000, 4, 3), (1000, 4096, 100_000)):
        v = rng.normal(size=n).round(2)
        v[: n // 3] = v[0]
        assert abs(geo.exact_median(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", bands, most).first().median - np.median(v)) < 1e-12
    assert geo.exact_median(spark.createDataFrame([], "v double"), "v").first().median is None


def test_generators_are_deterministic(spark):
    for name in registry.names():
        a, b = registry.load(spark, name), registry.load(spark, name)
        assert a.count() > 100 and a.exceptAll(b).count() == 0
    with pytest.raises(KeyError):
        registry.load(spark, "none")
