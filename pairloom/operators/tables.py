"""Small relational operators over result tables: levels, unions of grids, pairings, samples and checks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .results import nearest_by_value


def level_counts(df: DataFrame, column: str, levels: list[float], tolerance: float) -> DataFrame:
    """``level, n``: rows at each level, within a tolerance; a level that no row has counts 0."""
    grid = df.sparkSession.createDataFrame([(float(v),) for v in levels], "level double")
    return df.crossJoin(F.broadcast(grid)).groupBy("level").agg(F.count_if(F.abs(F.col(column) - F.col("level")) <= tolerance).alias("n"))


def best_level(df: DataFrame, unit: str, level: str, value: str) -> DataFrame:
    """The row of each unit with the largest value, the smallest level on ties."""
    w = Window.partitionBy(unit).orderBy(F.col(value).desc_nulls_last(), level)
    return df.withColumn("_p", F.row_number().over(w)).filter("_p = 1").drop("_p")


def extended_optimum(first: DataFrame, more: DataFrame, unit: str, level: str, value: str, cap) -> DataFrame:
    """``unit, old, best, at_cap, beyond``: the optimum on a grid and on its union with a further one."""
    old = best_level(first, unit, level, value).select(unit, F.col(level).alias("old"))
    best = best_level(first.unionByName(more), unit, level, value).select(unit, F.col(level).alias("best"))
    return old.join(best, unit).select(unit, "old", "best", (F.col("old") == cap).alias("at_cap"), (F.col("best") > cap).alias("beyond"))


def by_name_parts(df: DataFrame, name: str, size: Callable[[Column], Column]) -> DataFrame:
    """Rows named ``base__metric`` with ``metric`` and the ``size`` group of the base; other names are left out."""
    parts = F.split(name, "__")
    return df.filter(F.col(name).contains("__")).withColumn("metric", parts[1]).withColumn("size", size(parts[0]))


def paired_by_nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """``n, dominated, gain``: each left row (``dataset, seed, stab, qual``) against the right one of nearest stability
    (``other, s2, q2``): how many are dominated, and the median gain in quality in per cent."""
    met = nearest_by_value(left, right.withColumnRenamed("s2", "w"), "dataset", "stab", "w", "other").filter("nearest is not null")
    j = met.join(right, (met["dataset"] == right["dataset"]) & (met["nearest_id"] == right["other"]))
    worse = (F.col("s2") <= F.col("stab")) & (F.col("q2") <= F.col("qual")) & ((F.col("s2") < F.col("stab")) | (F.col("q2") < F.col("qual")))
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(worse).alias("dominated"), F.median(100 * F.try_divide(F.col("qual") - F.col("q2"), F.col("qual"))).alias("gain"))


def constancy(df: DataFrame, group: str, column: str) -> DataFrame:
    """How many groups there are, and in how many a column has one value only."""
    c = df.groupBy(group).agg(F.count_distinct(column).alias("k"))
    return c.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("k") == 1).alias("constant_groups"))


def only_row(df: DataFrame) -> DataFrame:
    """``df`` if it has one row; any other number is an error when it is read."""
    counted = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    ok = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("not exactly one row")).cast("boolean"))
    return counted.filter(ok).drop("_n")


def kinds(df: DataFrame, by: str, flag: str) -> DataFrame:
    """Rows by group where a flag is true, false and unknown."""
    return df.groupBy(by).agg(F.count_if(F.col(flag)).alias("synthetic"), F.count_if(~F.col(flag)).alias("real_"), F.count_if(F.col(flag).isNull()).alias("unknown"))


def with_significance(summary: DataFrame, tests: DataFrame, key: str, p: str, level: float) -> DataFrame:
    """The summary with each row's p value and whether it is below the level; a row without a test isn't significant."""
    return summary.join(tests.select(key, p), key, "left").withColumn("significant", F.coalesce(F.col(p) < level, F.lit(False)))


def pooled(core: DataFrame, held: DataFrame, synthetic: Column) -> DataFrame:
    """Both sets of data sets with their origin, and whether they are synthetic."""
    both = core.withColumn("origin", F.lit("core")).unionByName(held.withColumn("origin", F.lit("hold-out")))
    return both.withColumn("synthetic", synthetic)


def ellipses(points: DataFrame, n_std: float) -> DataFrame:
    """``label, cx, cy, width, height, angle``: each class's covariance ellipse in the map, axes of ``n_std`` deviations either way."""
    p = points.select("label", F.col("y")[0].alias("p"), F.col("y")[1].alias("q"))
    v = p.groupBy("label").agg(F.avg("p").alias("cx"), F.avg("q").alias("cy"), F.var_samp("p").alias("a"), F.var_samp("q").alias("b"), F.covar_samp("p", "q").alias("c"))
    half, root = (F.col("a") + F.col("b")) / 2, F.sqrt(((F.col("a") - F.col("b")) / 2) ** 2 + F.col("c") ** 2)
    axis = lambda v: 2 * n_std * F.sqrt(F.greatest(F.lit(0.0), v))
    return v.select("label", "cx", "cy", axis(half + root).alias("width"), axis(half - root).alias("height"), (F.degrees(F.atan2(2 * F.col("c"), F.col("a") - F.col("b"))) / 2).alias("angle"))


def _hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows that come first by a hash of their key and the seed; all if there are no more."""
    return df.orderBy(_hash_order(key, seed), key).limit(n)


def stratified_sample(df: DataFrame, key: str, label: str, n: int, seed: int) -> DataFrame:
    """About ``n`` rows, each class in proportion and none without a row, chosen by a hash; all if there are no more, and a
    uniform sample if there are fewer than two classes or not fewer than ``n``."""
    total, classes = df.agg(F.count(F.lit(1)), F.count_distinct(label)).first()
    if total <= n:
        return df
    if not 2 <= classes < n:
        return hash_sample(df, key, n, seed)
    c = df.groupBy(label).agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count(F.lit(1)) * n / total)).alias("_quota"))
    w = Window.partitionBy(label).orderBy(_hash_order(key, seed), key)
    return df.withColumn("_p", F.row_number().over(w)).join(F.broadcast(c), label).filter("_p <= _quota").drop("_p", "_quota")  # a row a class, fewer than n


def with_scope(df: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """``df`` with ``scope``: ``hold-out`` for the listed keys, ``core`` for others."""
    return df.join(held.select(key).distinct().withColumn("_held", F.lit(True)), key, "left").withColumn("scope", F.when(F.col("_held"), "hold-out").otherwise("core")).drop("_held")


def distinct_levels(df: DataFrame, unit: str, level: str, priority: str, digits: int) -> DataFrame:
    """``unit, level, place``: levels that differ when rounded, in the order of their first row by priority."""
    g = df.groupBy(unit, F.round(level, digits).alias("level")).agg(F.min(priority).alias("_first"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy(unit).orderBy("_first")) - 1).drop("_first")


def edge_index(edges: DataFrame) -> DataFrame:
    """``i, j``: edges by the numbers of their nodes in the order of names, self loops left out."""
    nodes = edges.select(F.col("u").alias("node")).unionAll(edges.select("v")).distinct()
    index = nodes.withColumn("k", F.row_number().over(Window.orderBy("node")) - 1)
    a, b = index.select(F.col("node").alias("u"), F.col("k").alias("i")), index.select(F.col("node").alias("v"), F.col("k").alias("j"))
    return edges.filter("u <> v").join(a, "u").join(b, "v").select("i", "j")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """``n, same``: whether two loads of a table have the same rows, as often each, by counts of rows."""
    cols = [F.col(c) for c in a.columns]
    counted = a.withColumn("_s", F.lit(1)).unionByName(b.withColumn("_s", F.lit(-1))).groupBy(*cols).agg(F.sum("_s").alias("_d"), F.count_if(F.col("_s") == 1).alias("_n"))
    return counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), (F.count_if(F.col("_d") != 0) == 0).alias("same"))


def spaced(df: DataFrame, name: str, value: str, gap: float) -> DataFrame:
    """The names that stay if labels are taken in the order of their values, each at least ``gap`` after the last taken.

    Sequential by nature; one row a label.
    """

    def run(frames):
        last = None
        for f in frames:
            keep = []
            for v in f[value]:
                keep.append(last is None or v - last >= gap)
                last = v if keep[-1] else last
            yield f[pd.Series(keep, index=f.index)]

    return df.select(name, value).coalesce(1).sortWithinPartitions(value, name).mapInPandas(run, df.select(name, value).schema)
