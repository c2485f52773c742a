"""Scenario table and its truth metrics against plain loops over the same points."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import truth
from pairloom.sources import scenarios

REPLICATES = [(0, "centres", 300, 5), (1, "tree", 400, 6), (2, "sheet", 250, 7), (3, "radii", 600, 8), (4, "tree", 90, 9), (5, "tree", 0, 1), (6, "tree", 1, 1)]


@pytest.fixture(scope="module")
def drawn(spark):
    r = spark.createDataFrame(REPLICATES, "replicate long, scenario string, n long, seed long").withColumn("x", F.lit("clash"))
    p = scenarios.scenario_points(r).withColumn("y", F.slice("x", 1, 2))
    points = {(v.replicate, v.id): v for v in p.collect()}
    got = {(v.replicate, v.scenario, v.metric): v.value for v in truth.scenario_truth(p, scenarios.tree_heights(), 500, 3).collect()}
    return p, points, got


def euclid(a, b):
    return float(np.linalg.norm(np.array(a) - np.array(b)))


def ranks(v):
    v = np.array(v)
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def test_every_replicate_has_its_points(drawn):
    _, points, _ = drawn
    for replicate, scenario, n, _ in REPLICATES:
        mine = [v for (r, _), v in points.items() if r == replicate]
        assert sorted(v.id for v in mine) == list(range(n)) and all(v.scenario == scenario for v in mine)
        assert all(len(v.path) == (scenarios.DEPTH if scenario == "tree" else 0) for v in mine)


def test_blocks_don_t_show(spark, monkeypatch):
    """Two blocks of a replicate share its centres, and a block's points don't depend on how many follow."""
    for scenario in scenarios.SCENARIOS:
        long, short = scenarios._block(scenario, 9000, 4, 0), scenarios._block(scenario, 4096, 4, 0)
        assert all((a == b).all() for a, b in zip(long, short))
        second = scenarios._block(scenario, 9000, 4, 1)
        if scenario == "centres":
            assert {tuple(t) for t in long[2]} == {tuple(t) for t in second[2]}
        assert not (second[3][:100] == long[3][:100]).all()
    r = spark.createDataFrame([(0, "tree", 9000, 4)], "replicate long, scenario string, n long, seed long")
    assert scenarios.scenario_points(r).agg(F.count_distinct("id")).first()[0] == 9000


def test_tree_and_sheet_by_loops(drawn):
    p, points, got = drawn
    pairs = defaultdict(list)
    for v in truth.sampled_pairs(p, 500, 3, []).collect():
        pairs[v.replicate].append((points[v.replicate, v.i], points[v.replicate, v.j]))
    for replicate in (1, 4):
        assert len(pairs[replicate]) > 480
        apart = [(a, b) for a, b in pairs[replicate] if a.leaf != b.leaf]
        u = [0.5 ** next(k for k in range(3) if a.path[k] != b.path[k]) for a, b in apart]
        want = np.corrcoef(ranks([euclid(a.y, b.y) for a, b in apart]), ranks(u))[0, 1]
        assert got[replicate, "tree", "tree_spearman"] == pytest.approx(want, abs=1e-9)
    t, y = (np.array([euclid(getattr(a, c), getattr(b, c)) for a, b in pairs[2]]) for c in "ty")
    assert got[2, "sheet", "pearson"] == pytest.approx(np.corrcoef(t, y)[0, 1])
    assert got[2, "sheet", "stress"] == pytest.approx(1 - (t @ y) ** 2 / (t @ t) / (y @ y))
    assert not any(r in (5, 6) for r, _, _ in got)  # no points, or no pair


def test_centres_and_radii_by_loops(drawn):
    _, points, got = drawn
    groups = lambda r: [[v for (k, _), v in points.items() if k == r and v.leaf == g] for g in range(scenarios.GROUPS)]
    c = [(np.mean([v.y for v in g], axis=0), g[0].t) for g in groups(0)]
    d = [(euclid(a[0], b[0]), euclid(a[1], b[1])) for k, a in enumerate(c) for b in c[k + 1 :]]
    e = np.log([a / b for a, b in d])
    assert got[0, "centres", "pearson"] == pytest.approx(np.corrcoef(np.array(d).T)[0, 1])
    assert got[0, "centres", "log_ratio_error"] == pytest.approx(np.median(abs(e - e.mean())))
    radii = [(np.sqrt(np.var([v.y for v in g], axis=0).sum()), g[0].t[0]) for g in groups(3)]
    assert got[3, "radii", "radius_slope"] == pytest.approx(np.polyfit(np.log([t for _, t in radii]), np.log([r for r, _ in radii]), 1)[0])


def test_the_metrics_see_a_map_without_structure(drawn):
    """Coordinates dealt to other points of the replicate: agreement goes, which label numbers alone wouldn't show."""
    p, _, got = drawn
    wrong = p.withColumn("y", F.array(F.rand(1), F.rand(2)))
    bad = {(v.replicate, v.metric): v.value for v in truth.scenario_truth(wrong, scenarios.tree_heights(), 500, 3).collect()}
    assert got[1, "tree", "tree_spearman"] > 0.4 > 0.15 > abs(bad[1, "tree_spearman"])
    # The sheet bends through 2.4 radians, so its projection folds: far from 1, and as far from none.
    assert got[2, "sheet", "pearson"] > 0.5 > 0.15 > abs(bad[2, "pearson"])
    assert got[3, "radii", "radius_slope"] > 0.8 > 0.15 > abs(bad[3, "radius_slope"])


def test_unknown_scenarios(spark):
    from pyspark.sql.functions import udtf

    with pytest.raises(Exception, match="no scenario"):
        udtf(scenarios._Scenario)(F.lit("knot"), F.lit(5), F.lit(0), F.lit(0))
    r = spark.createDataFrame([(0, "knot", 5, 1)], "replicate long, scenario string, n long, seed long")
    with pytest.raises(Exception, match="no scenario"):
        scenarios.scenario_points(r).collect()
