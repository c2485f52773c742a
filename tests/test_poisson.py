"""One-pass bootstrap against plain loops over rows and draws, and against resampling by index."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import poisson, resampling


def number(key):
    return int(hashlib.md5(("" if key is None else str(key)).encode()).hexdigest()[:7], 16)


def taken(key, draw, seed):
    """A row's weight by whole numbers of any size, and the inverse of a Poisson distribution added up term by term."""
    p = 2**31 - 1
    x = (number(key) * 48271 + draw * 69621 + seed) % p
    x = (x * x + draw) % p
    x = (x * x + seed) % p
    k, below = 0, math.floor(p * math.exp(-1))
    while x >= below and k < 10:
        k += 1
        below = math.floor(p * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)))
    return k + (x >= below)


def rows(n=300):
    r = random.Random(4)
    return [(r.choice(["a", "b", None]) if k else "only", k // 3 if k % 7 else None, r.gauss(2, 1), None if k % 11 == 0 and k else r.random()) for k in range(n)]


@pytest.mark.parametrize("held", [poisson.HELD, 1])
def test_sums_by_loops(spark, monkeypatch, held):
    monkeypatch.setattr(poisson, "HELD", held)
    data = rows()
    df = spark.createDataFrame(data, "g string, k long, x double, y double").repartition(3)
    got = {(r.group, r.draw): (r.w, r.sx, r.sy) for r in poisson.drawn_sums(df, "k", {"sx": F.col("x"), "sy": F.col("y")}, 40, 9, F.col("g")).collect()}
    want = {}
    for g, k, x, y in data:
        for d in range(40):
            if y is not None and (w := taken(k, d, 9)):
                t = want.setdefault((g, d), [0, 0, 0])
                t[0] += w
                t[1] += w * x
                t[2] += w * y
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k]) for k in want)


def test_weights_are_poisson():
    h = np.array([number(k) for k in range(4000)])
    w = poisson.weights(h, np.arange(100), 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    share = [(w == k).mean() for k in range(5)]
    assert np.allclose(share, [math.exp(-1) / math.factorial(k) for k in range(5)], atol=0.003)
    by_draw, by_row = np.corrcoef(w.T), np.corrcoef(w[:200])  # draws don't depend on each other, nor do rows
    assert abs(by_draw - np.eye(100)).max() < 0.09 and abs(by_row - np.eye(200)).max() < 0.5
    assert abs(by_draw[np.triu_indices(100, 1)].mean()) < 0.002 and abs(by_row[np.triu_indices(200, 1)].mean()) < 0.01


def test_interval_agrees_with_resampling_by_index(spark):
    df = spark.createDataFrame([(k, random.Random(k).gauss(5, 2)) for k in range(400)], "k long, x double")
    terms, mean = poisson.mean_of("x")
    a = poisson.interval(df, "k", terms, mean, 1000, 1).first()
    b = resampling.bootstrap_mean(df, "x", "k", 1000, 1).first()
    assert abs(a.low - b.low) < 0.05 and abs(a.high - b.high) < 0.05 and a.draws == 1000 and a.low < a.value < a.high


def test_correlation_and_slope_by_numpy(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=200)
    y = 2 * x + r.normal(size=200)
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "k long, x double, y double")
    w = poisson.weights(np.array([number(k) for k in range(200)]), np.arange(50), 3)
    for of, plain in ((poisson.slope_of, lambda a, b: np.polyfit(a, b, 1)[0]), (poisson.correlation_of, lambda a, b: np.corrcoef(a, b)[0, 1])):
        got = poisson.interval(df, "k", *of("x", "y"), 50, 3).first()
        each = [plain(np.repeat(x, w[:, d]), np.repeat(y, w[:, d])) for d in range(50)]
        assert np.allclose([got.value, got.low, got.high], [plain(x, y), *np.percentile(each, [2.5, 97.5])])


def test_no_rows_and_constant_values(spark):
    none = spark.createDataFrame([], "k long, x double")
    assert poisson.interval(none, "k", *poisson.mean_of("x"), 20, 0).collect() == []
    same = spark.createDataFrame([(k, 1.0, 2.0) for k in range(9)], "k long, x double, y double")
    got = poisson.interval(same, "k", *poisson.slope_of("x", "y"), 20, 0).first()
    assert (got.value, got.low, got.high, got.draws) == (None, None, None, 0)
    with pytest.raises(ValueError):
        poisson.drawn_sums(same, "k", {}, 0, 0)
