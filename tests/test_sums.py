"""Distance correlation and silhouette by tiles against the same over a table of pairs."""

import numpy as np
import pytest

from pairloom.operators import geometry as geo
from pairloom.operators import pairwise, tiles
from pairloom.plans.catalog import QUERIES


def points(spark, n, label):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, 10))
    return spark.createDataFrame([(7 * k, v.tolist(), v[:2].tolist(), label(k)) for k, v in enumerate(x)], "id long, x array<double>, y array<double>, label int")


@pytest.mark.parametrize("label", [lambda k: k * k % 5, lambda k: None if k % 7 == 0 else k % 3 if k else None, lambda k: k if k < 9 else 9, lambda k: k, lambda k: 1])
def test_sums_by_tiles(spark, monkeypatch, label):
    monkeypatch.setattr(tiles.over, "__defaults__", (("x", "y"), 30, False))
    monkeypatch.setattr(tiles, "HIGH", 7)
    monkeypatch.setattr(tiles, "WIDE", 16)
    p = points(spark, 101, label)
    pairs = geo.pairs(p)
    got, want = pairwise.silhouette(p).first()[0], geo.silhouette(pairs).first()[0]
    assert got == want or abs(got - want) < 1e-12
    assert abs(pairwise.distance_correlation(p).first()[0] - geo.distance_correlation(pairs).first()[0]) < 1e-9


def test_no_points_to_compare(spark):
    p = points(spark, 1, lambda k: 0)
    assert pairwise.silhouette(p).first()[0] is None and pairwise.distance_correlation(p).first()[0] is None


@pytest.mark.parametrize("name", ["m13_distance_correlation", "m14_silhouette"])
def test_no_pair_is_a_row(spark, monkeypatch, name):
    for f in ("pairs", "profile"):
        monkeypatch.setattr(geo, f, None)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").first()[0] is not None
