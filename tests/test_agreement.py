"""Agreement of two maps by tiles against the same over a table of pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import geometry as geo
from pairloom.operators import pairwise, tiles, truth
from pairloom.plans.catalog import QUERIES


@pytest.mark.parametrize("values", [50_000, 3])
def test_agreement_of_two_maps_needs_no_pairs(spark, monkeypatch, values):
    monkeypatch.setattr(tiles.dealt, "__defaults__", (20, False))
    monkeypatch.setattr(tiles.over, "__defaults__", (("x", "y"), 20, False))
    rng = np.random.default_rng(8)
    z, y = rng.normal(size=(61, 2)), rng.normal(size=(61, 2))
    z[7], y[9] = z[6], y[8]  # two pairs without a log ratio
    p = spark.createDataFrame([(3 * k, a.tolist(), b.tolist(), None) for k, (a, b) in enumerate(zip(z, y))], "id long, z array<double>, y array<double>, label long")
    pairs = [(float(np.hypot(*(z[i] - z[j]))), float(np.hypot(*(y[i] - y[j])))) for i in range(61) for j in range(i + 1, 61)]
    want = truth.agreement(spark.createDataFrame(pairs, "truth double, got double")).select("stress", "pearson", "log_ratio_error").first()
    monkeypatch.setattr(pairwise, "MEDIAN_VALUES", values)
    monkeypatch.setattr(geo, "pairs", None)
    assert np.allclose(pairwise.agreement(p, "z", "y").first(), want, rtol=1e-10)
    same = p.withColumn("y", F.array(F.lit(0.0), F.lit(0.0)))
    assert tuple(pairwise.agreement(same, "z", "y").first()) == (None, None, None)
    assert tuple(pairwise.agreement(p.limit(1), "z", "y").first()) == (None, None, None)
    assert pairwise.agreement(p.withColumn("y", F.col("z")), "z", "y").first().log_ratio_error == 0.0
    assert QUERIES["m25_geodesic"](spark, "/root/testdata/sf0.001").count() == 1
