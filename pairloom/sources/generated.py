"""Generated point sets: ids from ``spark.range``, coordinates by expressions over seeded hashes, so that reruns agree."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import dataset


def uniform(seed: int, stream: int) -> Column:
    """In [0, 1), by row id; other streams of a seed are independent."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(stream)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def normal(seed: int, stream: int) -> Column:
    """Standard normal by two uniforms."""
    return F.sqrt(-2.0 * F.log(1.0 - uniform(seed, 2 * stream))) * F.cos(2 * math.pi * uniform(seed, 2 * stream + 1))


def _points(spark: SparkSession, n: int, x: list[Column], label: Column | None = None) -> DataFrame:
    return spark.range(n).select("id", F.array(*x).alias("x"), (label if label is not None else F.lit(None)).cast("int").alias("label"))


@dataset("swiss_roll")
def swiss_roll(spark: SparkSession, n: int = 1000, seed: int = 0) -> DataFrame:
    t = 1.5 * math.pi * (1 + 2 * uniform(seed, 100))
    return _points(spark, n, [t * F.cos(t), 21.0 * uniform(seed, 101), t * F.sin(t)])


@dataset("s_curve")
def s_curve(spark: SparkSession, n: int = 1000, seed: int = 0) -> DataFrame:
    t = 3 * math.pi * (uniform(seed, 100) - 0.5)
    return _points(spark, n, [F.sin(t), 2.0 * uniform(seed, 101), F.signum(t) * (F.cos(t) - 1)])


@dataset("sphere")
def sphere(spark: SparkSession, n: int = 1000, seed: int = 0) -> DataFrame:
    z, a = 2 * uniform(seed, 100) - 1, 2 * math.pi * uniform(seed, 101)
    return _points(spark, n, [F.sqrt(1 - z * z) * F.cos(a), F.sqrt(1 - z * z) * F.sin(a), z])


@dataset("torus")
def torus(spark: SparkSession, n: int = 1000, seed: int = 0, outer: float = 3.0, inner: float = 1.0) -> DataFrame:
    a, b = 2 * math.pi * uniform(seed, 100), 2 * math.pi * uniform(seed, 101)
    ring = outer + inner * F.cos(b)
    return _points(spark, n, [ring * F.cos(a), ring * F.sin(a), inner * F.sin(b)])


@dataset("helix")
def helix(spark: SparkSession, n: int = 1000, turns: float = 4.0) -> DataFrame:
    t = 2 * math.pi * turns * F.col("id") / n
    return _points(spark, n, [F.cos(t), F.sin(t), t / (2 * math.pi)])


@dataset("two_moons")
def two_moons(spark: SparkSession, n: int = 1000, seed: int = 0, noise: float = 0.05) -> DataFrame:
    a, side = math.pi * uniform(seed, 100), F.col("id") % 2
    x = F.when(side == 0, F.cos(a)).otherwise(1 - F.cos(a)) + noise * normal(seed, 200)
    y = F.when(side == 0, F.sin(a)).otherwise(0.5 - F.sin(a)) + noise * normal(seed, 201)
    return _points(spark, n, [x, y], side)


@dataset("mobius_strip")
def mobius_strip(spark: SparkSession, n: int = 1000, seed: int = 0) -> DataFrame:
    a, w = 2 * math.pi * uniform(seed, 100), uniform(seed, 101) - 0.5
    r = 1 + w * F.cos(a / 2)
    return _points(spark, n, [r * F.cos(a), r * F.sin(a), w * F.sin(a / 2)])


@dataset("twin_peaks")
def twin_peaks(spark: SparkSession, n: int = 1000, seed: int = 0) -> DataFrame:
    x, y = 2 * uniform(seed, 100) - 1, 2 * uniform(seed, 101) - 1
    return _points(spark, n, [x, y, F.sin(math.pi * x) * F.tanh(3 * y)])


@dataset("trefoil_knot")
def trefoil_knot(spark: SparkSession, n: int = 1000) -> DataFrame:
    t = 2 * math.pi * F.col("id") / n
    return _points(spark, n, [F.sin(t) + 2 * F.sin(2 * t), F.cos(t) - 2 * F.cos(2 * t), -F.sin(3 * t)])


@dataset("grid")
def grid(spark: SparkSession, side: int = 20) -> DataFrame:
    return _points(spark, side * side, [F.floor(F.col("id") / side).cast("double"), (F.col("id") % side).cast("double")])


@dataset("gaussian_clusters")
def gaussian_clusters(spark: SparkSession, n: int = 1000, k: int = 5, dims: int = 10, spread: float = 6.0, seed: int = 0) -> DataFrame:
    c = F.col("id") % k
    centre = lambda d: spread * (F.pmod(F.xxhash64(c, F.lit(d), F.lit(seed)), F.lit(1 << 20)) / float(1 << 20) - 0.5)
    return _points(spark, n, [centre(d) + normal(seed, 300 + d) for d in range(dims)], c)


@dataset("bent_sheet")
def bent_sheet(spark: SparkSession, n: int = 1000, seed: int = 0, bend: float = 1.5) -> DataFrame:
    """A sheet rolled around a cylinder: the true coordinates are the first two uniforms of the row."""
    s, h = uniform(seed, 100), uniform(seed, 101)
    return _points(spark, n, [F.sin(bend * s) / bend, (1 - F.cos(bend * s)) / bend, h])


@dataset("tree_clusters")
def tree_clusters(spark: SparkSession, n: int = 1024, depth: int = 4, seed: int = 0) -> DataFrame:
    """Leaves of a binary tree as clusters; a level halves the step, so distances follow the level where leaves part."""
    leaf = F.col("id") % (1 << depth)
    axis = [F.when(F.shiftright(leaf, depth - 1 - d).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0) * 2.0 ** (depth - d) for d in range(depth)]
    return _points(spark, n, [a + 0.1 * normal(seed, 400 + d) for d, a in enumerate(axis)], leaf)


def bands(parameter: Column, low: float, high: float, n: int) -> Column:
    """The number of the equal band of a curve parameter, as a label."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((parameter - low) / (high - low) * n))).cast("int")


@dataset("severed_sphere")
def severed_sphere(spark: SparkSession, n: int = 1000, seed: int = 0, cap: float = 0.8, slit: float = 0.5) -> DataFrame:
    """A sphere without its poles and without a slit along a meridian."""
    z, a = cap * (2 * uniform(seed, 100) - 1), slit / 2 + (2 * math.pi - slit) * uniform(seed, 101)
    return _points(spark, n, [F.sqrt(1 - z * z) * F.cos(a), F.sqrt(1 - z * z) * F.sin(a), z], bands(a, 0.0, 2 * math.pi, 10))


@dataset("swiss_roll_hole")
def swiss_roll_hole(spark: SparkSession, n: int = 1000, seed: int = 0, hole: tuple = (0.4, 0.6, 0.3, 0.7)) -> DataFrame:
    """A roll with a rectangular hole in its two parameters: a row takes its first draw outside the hole.

    Of 64 draws a row needs more than are made with a probability below the hole's share to the power of 64; then it lies
    at the roll's inner edge.
    """
    t_low, t_high, h_low, h_high = hole
    draws = [F.struct(uniform(seed, 2 * k + 1000).alias("t"), uniform(seed, 2 * k + 1001).alias("h")) for k in range(64)]
    outside = F.filter(F.array(*draws), lambda d: ~(d["t"].between(t_low, t_high) & d["h"].between(h_low, h_high)))
    d = F.coalesce(F.get(outside, F.lit(0)), F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("h")))
    t = 1.5 * math.pi * (1 + 2 * d["t"])
    return _points(spark, n, [t * F.cos(t), 21.0 * d["h"], t * F.sin(t)], bands(d["t"], 0.0, 1.0, 10))


@dataset("klein_bottle_4d")
def klein_bottle_4d(spark: SparkSession, n: int = 1000, seed: int = 0, a: float = 2.0, b: float = 1.0) -> DataFrame:
    u, v = 2 * math.pi * uniform(seed, 100), 2 * math.pi * uniform(seed, 101)
    ring = a + b * F.cos(v)
    return _points(spark, n, [ring * F.cos(u), ring * F.sin(u), b * F.sin(v) * F.cos(u / 2), b * F.sin(v) * F.sin(u / 2)], bands(u, 0.0, 2 * math.pi, 10))


@dataset("hyperbolic_paraboloid")
def hyperbolic_paraboloid(spark: SparkSession, n: int = 1000, seed: int = 0) -> DataFrame:
    x, y = 2 * uniform(seed, 100) - 1, 2 * uniform(seed, 101) - 1
    return _points(spark, n, [x, y, x * x - y * y], bands(x, -1.0, 1.0, 10))


@dataset("anisotropic_ellipsoid")
def anisotropic_ellipsoid(spark: SparkSession, n: int = 1000, dims: int = 10, decay: float = 0.7, seed: int = 0) -> DataFrame:
    """A normal cloud whose axes shrink by a factor; labels are bands of the longest."""
    x = [decay**d * normal(seed, 500 + d) for d in range(dims)]
    return _points(spark, n, x, bands(x[0], -2.5, 2.5, 10))


def _centre(group: Column, d: int, seed: int, scale: float) -> Column:
    """One coordinate of a group's centre, normal."""
    u = lambda k: F.pmod(F.xxhash64(group, F.lit(d), F.lit(seed), F.lit(k)), F.lit(1 << 52)) / float(1 << 52)
    return scale * F.sqrt(-2.0 * F.log(1.0 - u(0))) * F.cos(2 * math.pi * u(1))


@dataset("hierarchical_clusters")
def hierarchical_clusters(spark: SparkSession, n: int = 1000, top: int = 4, sub: int = 3, dims: int = 10, top_std: float = 10.0, sub_std: float = 1.0, seed: int = 0) -> DataFrame:
    """Clusters of clusters; the label is the fine one, and its quotient by ``sub`` the coarse one."""
    c = F.col("id") % (top * sub)
    coarse = F.floor(c / sub)
    return _points(spark, n, [_centre(coarse, d, seed, top_std) + _centre(c, d, seed + 1, top_std / 3) + sub_std * normal(seed, 600 + d) for d in range(dims)], c)


def _apart(k: int, dims: int, least, spread: float, seed: int, attempts: int = 1000) -> np.ndarray:
    """Centres drawn until all pairs are at least as far apart as ``least`` says; an error if they never are."""
    rng = np.random.default_rng(seed)
    for _ in range(attempts):
        c = rng.normal(scale=spread, size=(k, dims))
        d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1)) + np.diag([np.inf] * k)
        if (d >= least).all():
            return c
    raise RuntimeError(f"no {k} centres that far apart in {attempts} attempts")


def _around(spark: SparkSession, n: int, centres: np.ndarray, std: list[float], dims: int, seed: int) -> DataFrame:
    k = len(centres)
    c = F.col("id") % k
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (c + 1).cast("int"))
    at = lambda d: pick(centres[:, d]) if d < centres.shape[1] else F.lit(0.0)
    return _points(spark, n, [at(d) + pick(std) * normal(seed, 700 + d) for d in range(dims)], c)


@dataset("gaussian_clusters_separated")
def gaussian_clusters_separated(spark: SparkSession, n: int = 1000, k: int = 6, dims: int = 10, spread: float = 10.0, least: float = 12.0, std: float = 1.0, seed: int = 0) -> DataFrame:
    return _around(spark, n, _apart(k, dims, least, spread, seed), [std] * k, dims, seed)


@dataset("planar_clusters")
def planar_clusters(spark: SparkSession, n: int = 1000, k: int = 6, dims: int = 10, small: float = 0.3, large: float = 2.0, apart: float = 3.0, spread: float = 20.0, seed: int = 0) -> DataFrame:
    """Clusters around centres of a plane with spreads in geometric progression, pairs apart by a multiple of their spreads:
    the true map is the first two coordinates."""
    std = [small * (large / small) ** (j / (k - 1)) for j in range(k)]
    least = apart * np.add.outer(std, std)
    return _around(spark, n, _apart(k, 2, least, spread, seed), std, dims, seed)


@dataset("density_pair")
def density_pair(spark: SparkSession, n: int = 1000, dims: int = 10, dense: int = 9, gap: float = 8.0, std: float = 1.0, seed: int = 0) -> DataFrame:
    """Two clusters of one spread, the first with ``dense`` times as many points: their radii are the same."""
    second = F.col("id") % (dense + 1) == dense
    first = F.when(second, gap).otherwise(0.0)
    return _points(spark, n, [(first if d == 0 else F.lit(0.0)) + std * normal(seed, 800 + d) for d in range(dims)], second.cast("int"))
