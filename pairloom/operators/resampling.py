"""Resampling tests, power and rule fitting. Draws come from hashes of (draw, row, seed), so reruns agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as dist
from .geometry import average_rank, pearson, ratio


def _numbered(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("o", F.row_number().over(Window.orderBy(order)) - 1)


def mc_sign_flip(pairs: DataFrame, draws: int, seed: int, alternative: str = "greater") -> DataFrame:
    """Monte-Carlo sign-flip p value, (hits + 1) / (draws + 1), as a plan: signs are hashes of (draw, data set, seed)."""
    d = pairs.filter(F.col("diff") != 0).select("dataset", "diff")
    total = d.agg(F.sum("diff").alias("total"), F.sum(F.abs("diff")).alias("size"))
    sign = F.when(F.xxhash64("draw", "dataset", F.lit(seed)).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
    s = d.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).groupBy("draw").agg(F.sum(sign * F.abs("diff")).alias("s"))
    slack = 1e-12 * F.col("size")
    far = {"greater": F.col("s") >= F.col("total") - slack, "less": F.col("s") <= F.col("total") + slack, "two-sided": F.abs("s") >= F.abs("total") - slack}[alternative]
    return s.crossJoin(F.broadcast(total)).agg(((F.count_if(far) + 1) / (F.lit(draws) + 1.0)).alias("p"), F.count(F.lit(1)).alias("draws"))


def permutation_spearman(df: DataFrame, x: str, y: str, key: str, draws: int, seed: int, alternative: str = "two-sided") -> DataFrame:
    """Spearman correlation and its permutation p value; a draw orders one side by hashes."""
    r = _numbered(df.dropna("any", subset=[x, y]), key).withColumn("rx", average_rank(x)).withColumn("ry", average_rank(y)).select("o", "rx", "ry")
    observed = r.agg(pearson("rx", "ry").alias("rho"))
    order = F.row_number().over(Window.partitionBy("draw").orderBy(F.xxhash64("draw", "o", F.lit(seed)), "o")) - 1
    shuffled = df.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(r)).withColumn("p", order).select("draw", "p", "rx")
    drawn = shuffled.join(F.broadcast(r.select(F.col("o").alias("p"), "ry")), "p").groupBy("draw").agg(pearson("rx", "ry").alias("r"))
    far = {"greater": F.col("r") >= F.col("rho") - 1e-12, "less": F.col("r") <= F.col("rho") + 1e-12, "two-sided": F.abs("r") >= F.abs("rho") - 1e-12}[alternative]
    return drawn.crossJoin(F.broadcast(observed)).agg(F.max("rho").alias("rho"), ((F.count_if(far) + 1) / (F.lit(draws) + 1.0)).alias("p"))


def cluster_slope_interval(df: DataFrame, x: str, y: str, cluster: str, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """OLS slope with a percentile interval over resampled clusters: a draw weighs clusters by how often it takes them."""
    moments = df.dropna("any", subset=[x, y]).groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(x) ** 2).alias("xx"))
    m = _numbered(moments, cluster)
    size = m.agg(F.count(F.lit(1)).alias("c"))
    taken = df.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(size)).select("draw", "c", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("k"))
    taken = taken.select("draw", F.pmod(F.xxhash64("draw", "k", F.lit(seed)), F.col("c")).alias("o")).join(F.broadcast(m), "o")
    slope = ratio(F.sum("xy") * F.sum("n") - F.sum("sx") * F.sum("sy"), F.sum("xx") * F.sum("n") - F.sum("sx") ** 2)
    per = taken.groupBy("draw").agg(slope.alias("s"))
    tail = (1 - level) / 2
    return per.agg(F.percentile("s", tail).alias("low"), F.percentile("s", 1 - tail).alias("high")).crossJoin(m.agg(slope.alias("slope")))


def bootstrap(df: DataFrame, key: str, columns: list[str], statistic, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """Percentile interval ``low, high`` of a statistic over rows drawn with replacement; a draw takes whole rows.

    ``statistic`` takes the drawn rows, with a column ``draw``, and gives ``draw, s``.
    """
    rows = _numbered(df.dropna("any", subset=columns), key).select("o", *columns)
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(n)).select("draw", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    picked = grid.select("draw", F.pmod(F.xxhash64("draw", "k", F.lit(seed)), F.col("n")).alias("o")).join(rows, "o").drop("o")
    tail = (1 - level) / 2
    return statistic(picked).agg(F.percentile("s", tail).alias("low"), F.percentile("s", 1 - tail).alias("high"))


def bootstrap_spearman(df: DataFrame, x: str, y: str, key: str, draws: int, seed: int) -> DataFrame:
    """Percentile interval of Spearman's correlation over resampled rows."""

    def rho(picked: DataFrame) -> DataFrame:
        r = picked.withColumn("rx", average_rank(x, "draw")).withColumn("ry", average_rank(y, "draw"))
        return r.groupBy("draw").agg(pearson("rx", "ry").alias("s"))

    return bootstrap(df, key, [x, y], rho, draws, seed)


def bootstrap_mean(df: DataFrame, x: str, key: str, draws: int, seed: int) -> DataFrame:
    return bootstrap(df, key, [x], lambda p: p.groupBy("draw").agg(F.avg(x).alias("s")), draws, seed)


def power_table(pairs: DataFrame, level: float, power: float, sizes: list[int], robust: bool = False) -> DataFrame:
    """Power of one-sided paired tests at each size, and the sizes that Noether's formula and the t approximation ask for.

    The effect is the median difference, its spread the standard deviation or, if ``robust``, 1.4826 times the median
    absolute deviation; the sign test's share is that of positive differences. Without an effect above 0 the sizes are
    infinite. ``n, noether, t, sign, noether_n, t_n``.
    """
    m = pairs.agg(F.median("diff").alias("mu"), F.stddev_samp("diff").alias("sd"), F.avg((F.col("diff") > 0).cast("double")).alias("share"))
    mad = pairs.crossJoin(F.broadcast(m.select("mu"))).agg((1.4826 * F.median(F.abs(F.col("diff") - F.col("mu")))).alias("robust_sd"))
    s = m.crossJoin(mad).withColumn("sigma", F.col("robust_sd" if robust else "sd")).withColumn("effect", ratio(F.col("mu"), F.col("sigma")))
    s = s.withColumn("above", dist.normal_below(F.sqrt(F.lit(2.0)) * F.col("effect")) - 0.5)
    grid = pairs.sparkSession.createDataFrame([(n,) for n in sizes], "n int")
    za, zb = dist.normal_quantile(1 - level), dist.normal_quantile(power)
    n = F.col("n").cast("double")
    endless = F.lit(float("inf"))
    return s.crossJoin(F.broadcast(grid)).select(
        "n", dist.normal_below(F.sqrt(3.0 * n) * F.col("above") - za).alias("noether"), dist.normal_below(F.sqrt(n) * F.col("effect") - za).alias("t"), dist.sign_power("share", F.lit(level), n).alias("sign"),
        F.when(F.col("above") > 0, (za + zb) ** 2 / (3 * F.col("above") ** 2)).otherwise(endless).alias("noether_n"), F.when(F.col("effect") > 0, (za + zb) ** 2 / F.col("effect") ** 2).otherwise(endless).alias("t_n"),
    )


def wilcoxon_power(pairs: DataFrame, level: float, sizes: list[int], draws: int, seed: int) -> DataFrame:
    """``n, power``: share of resamples of n differences in which the one-sided signed-rank test, by its normal form with
    correction for continuity, rejects at ``level``."""
    rows = _numbered(pairs.select("dataset", "diff"), "dataset").select("o", "diff")
    m = rows.agg(F.count(F.lit(1)).alias("m"))
    grid = pairs.sparkSession.createDataFrame([(n,) for n in sizes], "n int").crossJoin(F.broadcast(m)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    picked = grid.select("n", "draw", F.pmod(F.xxhash64("n", "draw", "k", F.lit(seed)), F.col("m")).alias("o")).join(rows, "o").filter("diff <> 0").withColumn("a", F.abs("diff"))
    ranked = picked.withColumn("rank", average_rank("a", "n", "draw")).withColumn("t", F.count(F.lit(1)).over(Window.partitionBy("n", "draw", "a")))
    per = ranked.groupBy("n", "draw").agg(F.count(F.lit(1)).cast("double").alias("c"), F.coalesce(F.sum(F.when(F.col("diff") > 0, F.col("rank"))), F.lit(0.0)).alias("w"), F.sum(F.col("t").cast("double") ** 2 - 1).alias("ties"))
    c = F.col("c")
    z = ratio(F.col("w") - c * (c + 1) / 4 - 0.5, F.sqrt(c * (c + 1) * (2 * c + 1) / 24 - F.col("ties") / 48))
    return per.groupBy("n").agg((F.count_if(z > dist.normal_quantile(1 - level)) / F.lit(float(draws))).alias("power"))


def leave_one_out(train: DataFrame, grid: list[float]) -> DataFrame:
    """Leave-one-out choice of a threshold: for each held-out row, the threshold of the grid with the least squared error
    of the two sides' means on the others, and the error of its prediction. Rows are ``dataset, x, y``."""
    t = train.sparkSession.createDataFrame([(float(g),) for g in grid], "t double")
    held = train.select(F.col("dataset").alias("held"), F.col("x").alias("hx"), F.col("y").alias("hy"))
    # Sums of all rows per (threshold, side), less the held-out row: no row is paired with all others.
    side = train.crossJoin(F.broadcast(t)).groupBy("t", (F.col("x") < F.col("t")).alias("low")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") ** 2).alias("q"))
    wide = side.groupBy("t").agg(*[F.coalesce(F.max(F.when(F.col("low") == b, F.col(c))), F.lit(0)).cast("double").alias(f"{c}{int(b)}") for b in (True, False) for c in ("n", "s", "q")])
    h = held.crossJoin(F.broadcast(wide)).withColumn("low", F.col("hx") < F.col("t"))
    less = lambda c, b, v: F.col(f"{c}{int(b)}") - F.when(F.col("low") == b, v).otherwise(0.0)
    sse = sum((less("q", b, F.col("hy") ** 2) - F.coalesce(ratio(less("s", b, F.col("hy")) ** 2, less("n", b, F.lit(1.0))), F.lit(0.0)) for b in (True, False)), F.lit(0.0))
    mean = F.when(F.col("low"), ratio(less("s", True, F.col("hy")), less("n", True, F.lit(1.0)))).otherwise(ratio(less("s", False, F.col("hy")), less("n", False, F.lit(1.0))))
    best = h.withColumn("sse", sse).withColumn("predicted", mean).withColumn("p", F.row_number().over(Window.partitionBy("held").orderBy(F.round("sse", 6), "t"))).filter("p = 1")
    return best.select("held", "t", "predicted", (F.col("hy") - F.col("predicted")).alias("error"))


def average_linkage(correlations: DataFrame, threshold: float) -> DataFrame:
    """``metric, cluster`` by average linkage at distance 1 - abs(rho), cut at ``threshold``; a handful of metrics."""
    one = correlations.groupBy().agg(F.sort_array(F.collect_list(F.struct("a", "b", F.coalesce("rho", F.lit(0.0)).alias("rho")))).alias("rows"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = batch.column(0)[0].as_py()
            names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
            d = np.zeros((len(names),) * 2)
            for r in rows:
                i, j = names.index(r["a"]), names.index(r["b"])
                d[i, j] = d[j, i] = 1 - abs(r["rho"])
            groups = [[k] for k in range(len(names))]
            while len(groups) > 1:
                gap, i, j = min((d[np.ix_(groups[i], groups[j])].mean(), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
                if gap > threshold:
                    break
                groups[i] += groups.pop(j)
            label = {names[k]: min(names[m] for m in g) for g in groups for k in g}
            yield pa.RecordBatch.from_arrays([pa.array(list(label)), pa.array(list(label.values()))], names=["metric", "cluster"])

    return one.mapInArrow(run, "metric string, cluster string")


def greedy_makespan(durations: DataFrame, workers: int) -> DataFrame:
    """End of a greedy schedule of jobs in order; sequential by nature, one task over durations only."""

    def run(frames):
        import heapq

        ends = [0.0] * workers
        for f in frames:
            for v in f.seconds:
                heapq.heappush(ends, heapq.heappop(ends) + float(v))
        yield pd.DataFrame({"makespan": [max(ends)]})

    return durations.coalesce(1).sortWithinPartitions("job").select("seconds").mapInPandas(run, "makespan double")
