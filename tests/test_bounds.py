import numpy as np
import pytest

from pairloom.operators import bounds, truth
from pairloom.operators import resampling as rs

A, B = 1.0, 1.5
PAIR = "i long, j long, d_hi double, d_lo double, d_ref double"


def best(alpha):
    t = (A / B) ** alpha
    return (A + t * B) / (1 + 2 * t)


def three_points(spark, alpha):
    """Three points on a line: distances 1, 1.5, 1 between them, mapped to x, 2x, x."""
    x, x0 = best(alpha), best(0)
    return spark.createDataFrame([(0, 1, A, x, x0), (0, 2, B, 2 * x, 2 * x0), (1, 2, A, x, x0)], PAIR)


@pytest.mark.parametrize(("alpha", "delta", "c", "gamma", "bound", "prime"), [(1, 0.040816, 0.176777, 0.415879, 0.079343, 0.037064), (2, 0.172996, 0.321346, 0.813241, 0.353755, 0.154106), (3, 0.390527, 0.433444, 1.097337, 0.907207, 0.371501)])
def test_published_three_point_family(spark, alpha, delta, c, gamma, bound, prime):
    g = bounds.gaps(three_points(spark, alpha), alpha, 0.0).first()
    assert np.allclose([g.delta, g.weight_cv, g.gamma, g.bound, g.delta_prime], [delta, c, gamma, bound, prime], rtol=2e-3)  # the published values are rounded on the way
    assert abs(g.identity_residual) < 1e-9 and abs(g.r + 1) < 1e-9


def test_published_local_index(spark):
    p = three_points(spark, 0).selectExpr("'d' dataset", "i", "j", "d_hi")
    maps = spark.createDataFrame([("d", k, [k * best(0)]) for k in range(3)], "dataset string, id long, y array<double>")
    assert abs(bounds.local_index(p, maps, 0.0).first().exact - 2 * np.log(B / A) ** 2 / 9) < 1e-9


def test_near_residual_is_below_its_bounds(spark):
    rng = np.random.default_rng(0)
    rows = [(0, k, float(d), float(d), float(d + e)) for k, (d, e) in enumerate(zip(rng.uniform(1, 5, 50), rng.normal(size=50)))]
    b = bounds.block_bounds(spark.createDataFrame(rows, PAIR), 2, 0.1, 2.0, 3.5).first()
    assert b.holds and b.near == 0 and b.slack_a > 0 and b.bound_b >= b.bound_a


def test_truth_metrics_are_free_of_scale(spark):
    rows = [(a, b, float(3 * (b - a) + a), float(b - a + a / 3)) for a in range(4) for b in range(a + 1, 4)]
    t = truth.agreement(spark.createDataFrame(rows, "ca int, cb int, truth double, got double")).first()
    assert abs(t.pearson - 1) < 1e-12 and abs(t.stress) < 1e-12 and t.log_ratio_error < 1e-12 and t.log_distortion < 1e-12
    assert truth.triplet_accuracy(spark.createDataFrame(rows, "ca int, cb int, truth double, got double")).first().triplet_accuracy == 1


def test_resampling(spark):
    p = spark.createDataFrame([(f"d{k:02}", float(k - 2), float(k), float(k * k)) for k in range(20)], "dataset string, diff double, va double, vb double")
    assert rs.mc_sign_flip(p, 500, 1).first().p < 0.01
    r = rs.permutation_spearman(p, "va", "vb", "dataset", 200, 1).first()
    assert abs(r.rho - 1) < 1e-12 and r.p < 0.02
    s = rs.cluster_slope_interval(p, "va", "vb", "dataset", 200, 1).first()
    assert s.low <= s.slope <= s.high
    powers = [(x.noether, x.t, x.sign) for x in rs.power_table(p, 0.05, 0.8, [2, 10, 200]).collect()]
    assert powers == sorted(powers) and powers[-1][0] > 0.999


def test_published_sizes(spark):
    # Ten published differences: Noether's sizes are 25.6 with the robust sigma and 66.1 with the standard deviation.
    import math

    from pairloom.functions import distributions as dist

    za, zb = dist.normal_quantile(0.975), dist.normal_quantile(0.8)
    size = lambda mu, sigma: (za + zb) ** 2 / (3 * (dist.normal_cdf(math.sqrt(2) * mu / sigma) - 0.5) ** 2)
    assert abs(size(0.03335, 1.4826 * 0.0348) - 25.6) < 0.1 and abs(size(0.03335, 0.0903) - 66.1) < 0.3  # of rounded figures
    d = [0.4, -0.2, 0.9, 1.1, 0.3, 0.8, -0.1, 0.7]
    p = spark.createDataFrame([(f"d{k}", v) for k, v in enumerate(d)], "dataset string, diff double")
    mu, sd = float(np.median(d)), float(np.std(d, ddof=1))
    r = rs.power_table(p, 0.025, 0.8, [10]).first()
    assert abs(r.noether_n - size(mu, sd)) < 1e-6 and abs(r.t - dist.normal_cdf(math.sqrt(10) * mu / sd - za)) < 1e-9
    assert abs(r.sign - sum(math.comb(10, k) * 0.75**k * 0.25 ** (10 - k) for k in range(9, 11))) < 1e-9  # 9 of 10 is critical


def test_linkage_and_makespan(spark):
    c = spark.createDataFrame([("a", "b", 0.95), ("a", "c", 0.1), ("b", "c", -0.2)], "a string, b string, rho double")
    assert {r.metric: r.cluster for r in rs.average_linkage(c, 0.3).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert rs.greedy_makespan(spark.createDataFrame([(k, v) for k, v in enumerate((5.0, 3.0, 2.0, 4.0))], "job int, seconds double"), 2).first().makespan == 9.0


def test_certificates(spark):
    b = spark.createDataFrame([("ref", 10.0, 1.0, 0.0), ("w", 0.0, 2.0, 8.0)], "name string, near double, mid double, far double")
    c = bounds.certificate(b, "ref", 3.0, 0.5, 2.0).first()
    assert c.witness == "w" and abs(c.certified - ((10 + 0.125) / (2 + 1) - 1)) < 1e-12
    a = bounds.certified_from(10.0, 0.0, 2.0, 8.0, 0.5, 0.5, 2.0, 10.0)
    assert abs(1.5 * (2 + 8 * 0.5**a) - 10) < 1e-6
    assert bounds.certified_from(1.0, 0.0, 2.0, 8.0, 0.5, 0.5, 2.0, 10.0) is None
