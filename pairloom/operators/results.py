"""Analytics over result tables: one row per run with ``dataset, method, seed, status`` and metrics.

The unit of inference is the dataset: seeds are summarised first. Ties go to the first row in a stated order.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distributions as dist
from .geometry import average_rank, pearson, ratio, within


def ok(results: DataFrame, metric: str) -> DataFrame:
    """Runs that succeeded and have the metric."""
    return results.filter((F.col("status") == "ok") & F.col(metric).isNotNull())


def median_iqr(results: DataFrame, metric: str, *by: str) -> DataFrame:
    """Median, interquartile range and count of a metric over each group's runs."""
    q = F.percentile(metric, F.array(F.lit(0.25), F.lit(0.75)))
    out = ok(results, metric).groupBy(*by).agg(F.median(metric).alias("median"), q.alias("q"), F.count(F.lit(1)).alias("n"))
    return out.select(*by, "median", (F.col("q")[1] - F.col("q")[0]).alias("iqr"), "n")


def medians(results: DataFrame, metric: str) -> DataFrame:
    """``dataset, method, v``: the median over seeds."""
    return ok(results, metric).groupBy("dataset", "method").agg(F.median(metric).alias("v"))


def two_level_median(results: DataFrame, metric: str) -> DataFrame:
    """Median over datasets of medians over seeds."""
    return medians(results, metric).groupBy("method").agg(F.median("v").alias("median"), F.count(F.lit(1)).alias("n_datasets"))


def complete(wide: DataFrame) -> DataFrame:
    """Only the datasets that have all methods; the number of methods is a small aggregate."""
    k = wide.agg(F.count_distinct("method").alias("k"))
    have = wide.withColumn("have", F.count(F.lit(1)).over(Window.partitionBy("dataset")))
    return have.crossJoin(F.broadcast(k)).filter("have = k").drop("have", "k")


def average_ranks(wide: DataFrame, lower_is_better: bool = True) -> DataFrame:
    """Mean over complete datasets of the average rank of each method."""
    v = F.col("v") if lower_is_better else -F.col("v")
    ranked = complete(wide).withColumn("o", v).withColumn("rank", average_rank("o", "dataset"))
    return ranked.groupBy("method").agg(F.avg("rank").alias("avg_rank"), F.count(F.lit(1)).alias("n"))


def friedman(wide: DataFrame) -> DataFrame:
    """Friedman's chi squared with tie correction, its p value and Kendall's W, over complete datasets."""
    ranked = complete(wide).withColumn("rank", average_rank("v", "dataset")).withColumn("t", F.count(F.lit(1)).over(Window.partitionBy("dataset", "v")))
    per = ranked.groupBy("method").agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("n"))
    sums = per.agg(F.sum(F.col("s") ** 2).alias("s2"), F.max("n").cast("double").alias("n"), F.count(F.lit(1)).cast("double").alias("k"))
    ties = ranked.agg(F.sum(F.col("t").cast("double") ** 2 - 1).alias("ties"))  # over rows, each tie group adds t^3 - t
    n, k = F.col("n"), F.col("k")
    chi = ratio(12 / (n * k * (k + 1)) * F.col("s2") - 3 * n * (k + 1), 1 - F.col("ties") / (n * (k**3 - k)))
    row = sums.crossJoin(ties).select(chi.alias("chi2"), n.cast("int").alias("n"), k.cast("int").alias("k"))
    return row.select("n", "k", "chi2", (F.col("chi2") / (F.col("n") * (F.col("k") - 1))).alias("kendall_w"), dist.chi2_sf("chi2", F.col("k") - 1).alias("p"))


def critical_difference(ranks: DataFrame, level: float = 0.05) -> DataFrame:
    """Nemenyi's critical difference of average ranks, for any number of methods: the quantile of the studentized range
    with infinite degrees of freedom comes from its integral. NULL below two methods."""
    s = ranks.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    q = dist.nemenyi_q(F.when(F.col("k") > 1, F.col("k")), F.lit(level))
    return s.select("k", "n", (q * F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n")))).alias("cd"))


def cliques(ranks: DataFrame, cd: float) -> DataFrame:
    """Maximal sets of methods whose average ranks differ by less than ``cd``, as first and last method in rank order."""
    order = Window.orderBy("avg_rank", "method")
    r = ranks.select("method", "avg_rank", F.row_number().over(order).alias("p"))
    o = r.select(F.col("method").alias("last"), F.col("avg_rank").alias("r2"), F.col("p").alias("p2"))
    reach = r.join(o, (F.col("p2") >= F.col("p")) & (F.col("r2") - F.col("avg_rank") < cd)).groupBy("p", "method").agg(F.max(F.struct("p2", "last")).alias("e"))
    before = F.max("e.p2").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    kept = reach.withColumn("b", before).filter((F.col("e.p2") > F.col("p")) & (F.col("b").isNull() | (F.col("e.p2") > F.col("b"))))
    return kept.select(F.col("method").alias("first"), F.col("e.last").alias("last"), (F.col("e.p2") - F.col("p") + 1).alias("size"))


def best_per_dataset(wide: DataFrame) -> DataFrame:
    """The method with the largest value, the first by name on ties."""
    w = Window.partitionBy("dataset").orderBy(F.desc("v"), "method")
    return wide.withColumn("p", F.row_number().over(w)).filter("p = 1").select("dataset", "method", "v")


def constrained_best(wide: DataFrame, cost: DataFrame, baseline: str, slack: float) -> DataFrame:
    """The best method among those whose cost is at most ``slack`` times the baseline method's on the same dataset."""
    base = cost.filter(F.col("method") == baseline).select("dataset", F.col("v").alias("base"))
    allowed = cost.select("dataset", "method", F.col("v").alias("cost")).join(base, "dataset").filter(F.col("cost") <= slack * F.col("base"))
    return best_per_dataset(wide.join(allowed, ["dataset", "method"]).select("dataset", "method", "v"))


def paired(wide: DataFrame, a: str, b: str) -> DataFrame:
    """``dataset, va, vb, diff`` of the datasets that have both methods."""
    p = wide.filter(F.col("method").isin(a, b)).groupBy("dataset").agg(F.max(F.when(F.col("method") == a, F.col("v"))).alias("va"), F.max(F.when(F.col("method") == b, F.col("v"))).alias("vb"))
    return p.dropna("any", subset=["va", "vb"]).withColumn("diff", F.col("va") - F.col("vb"))


def wins(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count_if(F.col("diff") > 0).alias("wins_a"), F.count_if(F.col("diff") < 0).alias("wins_b"), F.count_if(F.col("diff") == 0).alias("ties"))


def mcnemar(flags: DataFrame, a: str, b: str) -> DataFrame:
    """The 2 x 2 table of two indicator columns and the exact two-sided p value of its discordant counts (NULL if none)."""
    t = flags.agg(*[F.count_if((F.col(a) == x) & (F.col(b) == y)).alias(f"n{int(x)}{int(y)}") for x in (True, False) for y in (True, False)])
    return t.withColumn("p", dist.binomial_two_sided(F.col("n10"), F.col("n10") + F.col("n01")))


def relative_to_baseline(results: DataFrame, metric: str, level: str, keys: list[str]) -> DataFrame:
    """Each row's metric over that of the row at ``level`` = 0 with the same keys; NULL keys match each other.

    Groups without such a row are left out; a baseline of 0 or NULL gives NULL.
    """
    group = Window.partitionBy(*keys)
    base = F.max(F.when(F.col(level) == 0, F.col(metric))).over(group)
    has = F.max((F.col(level) == 0).cast("int")).over(group)
    return results.withColumn("relative", ratio(F.col(metric), base)).withColumn("_has", has).filter("_has = 1").drop("_has")


def nearest_by_value(left: DataFrame, right: DataFrame, key: str, a: str, b: str, tiebreak: str) -> DataFrame:
    """For each left row the right row of its key whose ``b`` is nearest to ``a``; the first by ``tiebreak`` on ties.

    Left and right values share one ordered pass per key: the candidates are the last right value at or below and the
    first above, carried along by windows, so no key's rows are paired with each other.
    """
    l = left.withColumn("side", F.lit(1)).withColumn("at", F.col(a))
    rights = right.groupBy(key, b).agg(F.min(tiebreak).alias("tb")).select(key, F.col(b).alias("at"), F.struct(F.col(b).alias("v"), "tb").alias("cand"), F.lit(0).alias("side"))
    both = l.unionByName(rights, allowMissingColumns=True)
    down = Window.partitionBy(key).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(key).orderBy(F.desc("at"), "side").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("below", F.last("cand", True).over(down)).withColumn("above", F.last("cand", True).over(up)).filter("side = 1")
    gap = lambda c: F.abs(F.col(f"{c}.v") - F.col(a))
    first = F.col("above").isNull() | (gap("below") < gap("above")) | ((gap("below") == gap("above")) & (F.col("below.tb") <= F.col("above.tb")))
    pick = F.when(F.col("below").isNotNull() & first, F.col("below")).otherwise(F.col("above"))
    return near.withColumn("pick", pick).select(*left.columns, F.col("pick.v").alias("nearest"), F.col("pick.tb").alias("nearest_id"))


def interpolate(grid: DataFrame, at: DataFrame, key: str, x: str, y: str, want: str) -> DataFrame:
    """Linear interpolation of each key's (x, y) grid at ``want``, clamped at the ends."""
    w = Window.partitionBy(key).orderBy(x)
    g = grid.select(key, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), F.lag(x).over(w).isNull().alias("first"))
    inside = (F.col("x0") <= F.col(want)) & (F.col("x1").isNull() | (F.col(want) < F.col("x1")))
    j = at.join(g, key).filter(inside | (F.col("first") & (F.col(want) < F.col("x0"))))
    flat = F.col("x1").isNull() | (F.col(want) < F.col("x0"))
    line = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col(want) - F.col("x0")) / (F.col("x1") - F.col("x0"))
    return j.select(key, want, F.when(flat, F.col("y0")).otherwise(line).alias("value"))


def pareto_front(points: DataFrame, group: str, item: str, m1: str, m2: str) -> DataFrame:
    """Items that no other of the group dominates (both metrics at least as large, one larger); NULLs are never on it.

    In two dimensions one ordered pass does: by m1 descending, a row is dominated if a row with a larger m1 has an m2 at
    least as large, or one with the same m1 has a larger m2.
    """
    p = points.dropna("any", subset=[m1, m2])
    larger = F.max(m2).over(Window.partitionBy(group).orderBy(F.desc(m1)).rangeBetween(Window.unboundedPreceding, 0))
    same = F.max(m2).over(Window.partitionBy(group, m1))
    strict = p.groupBy(group, m1).agg(F.max(m2).alias("top")).withColumn("above", F.max("top").over(Window.partitionBy(group).orderBy(F.desc(m1)).rowsBetween(Window.unboundedPreceding, -1)))
    q = p.withColumn("same", same).join(strict.select(group, m1, "above"), [group, m1])
    return q.filter((F.col("same") <= F.col(m2)) & (F.col("above").isNull() | (F.col("above") < F.col(m2)))).select(group, item, m1, m2)


def wilcoxon(pairs: DataFrame, least: int = 5) -> DataFrame:
    """Signed-rank test, two-sided: ``n`` differences, ``n_nonzero``, ``w_plus``, ``z`` and ``p``.

    p is exact for up to 50 differences without zeros and ties, and by the normal form with tie correction otherwise;
    NULL with fewer than ``least`` differences, zeros counted, or if all are zero.
    """
    every = pairs.agg(F.count("diff").alias("n"))
    d = pairs.filter("diff <> 0").withColumn("a", F.abs("diff")).withColumn("rank", average_rank("a")).withColumn("t", F.count(F.lit(1)).over(Window.partitionBy("a")))
    s = d.agg(F.count(F.lit(1)).alias("n_nonzero"), F.coalesce(F.sum(F.when(F.col("diff") > 0, F.col("rank"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.col("t").cast("double") ** 2 - 1), F.lit(0.0)).alias("ties")).crossJoin(every)
    m = F.col("n_nonzero").cast("double")
    z = ratio(F.col("w_plus") - m * (m + 1) / 4, F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("ties") / 48))
    known = (F.col("n") >= least) & (F.col("n_nonzero") > 0)
    small = (F.col("n") <= 50) & (F.col("n_nonzero") == F.col("n")) & (F.col("ties") == 0)
    out = s.select("n", "n_nonzero", "w_plus", F.when(known, z).alias("z"), (known & small).alias("exact"))
    p = F.when(F.col("exact"), dist.signed_rank_two_sided(F.when(F.col("exact"), F.col("w_plus")), "n")).otherwise(dist.normal_two_sided("z"))
    return out.withColumn("p", p)


ALTERNATIVES = ("greater", "less", "two-sided")


def sign_flip_p(d: np.ndarray, alternative: str, most: int, draws: int, seed: int) -> float | None:
    """p value of the sum of differences under random signs, zeros left out; exact up to ``most``, Monte Carlo beyond."""
    d = np.asarray(d, float)
    d = d[d != 0]
    if not len(d):
        return None
    total, size, slack = d.sum(), np.abs(d), 1e-9 * np.abs(d).sum()
    # A sum is as large as the observed one, as small, or as far out, up to the error of adding in another order.
    far = {"greater": lambda v: v >= total - slack, "less": lambda v: v <= total + slack, "two-sided": lambda v: v >= abs(total) - slack}[alternative]
    if len(d) > most:
        rng = np.random.default_rng(seed)
        step = max(1, (1 << 22) // len(d))
        drawn = (rng.integers(0, 2, (min(step, draws - i), len(d))) * 2.0 - 1.0 for i in range(0, draws, step))
        return (sum(int(far(np.abs(s @ size) if alternative == "two-sided" else s @ size).sum()) for s in drawn) + 1) / (draws + 1)
    sums = lambda part: reduce(lambda v, x: np.concatenate([v + x, v - x]), part, np.zeros(1))
    half, other = sums(size[: len(d) // 2]), np.sort(sums(size[len(d) // 2 :]))
    if alternative == "less":
        hits = np.searchsorted(other, total + slack - half, side="right").sum()
    else:
        least = total if alternative == "greater" else abs(total)
        hits = (len(other) - np.searchsorted(other, least - slack - half, side="left")).sum()
    return float(min(1.0, (2.0 if alternative == "two-sided" else 1.0) * hits / 2.0 ** len(d)))


def sign_flip_column(diffs: Column, alternative: str, most: int = 22, draws: int = 10_000, seed: int = 0) -> Column:
    """The test of an array column of differences; its elements are one a data set."""
    if alternative not in ALTERNATIVES:
        raise ValueError(f"unknown alternative {alternative}")

    @F.pandas_udf("double")
    def p(d: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else sign_flip_p(x, alternative, most, draws, seed) for x in d], dtype=float)

    return F.nanvl(p(diffs), F.lit(None).cast("double"))


def sign_flip(pairs: DataFrame, alternative: str = "greater", most: int = 22, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """``n`` non-zero differences, ``p``, and whether it is ``exact``: all sign patterns are counted up to ``most`` differences,
    by halves that meet, and ``draws`` random ones beyond."""
    listed = pairs.filter("diff <> 0").agg(F.transform(F.sort_array(F.collect_list(F.struct("dataset", "diff"))), lambda r: r["diff"]).alias("d"))
    return listed.select(F.size("d").alias("n"), sign_flip_column(F.col("d"), alternative, most, draws, seed).alias("p"), (F.size("d") <= most).alias("exact"))


def paired_dominance(pairs: DataFrame) -> DataFrame:
    """Share of positive less share of negative differences; NULL without any."""
    return pairs.agg(F.avg(F.signum("diff")).alias("delta_pair"))


def family_tests(long: DataFrame, families: DataFrame, alternative: str = "two-sided", most: int = 22, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """One row for each hypothesis of ``families`` (``family, hypothesis, role, metric, method_a, method_b``), tested on the
    data sets of ``long`` (``dataset, method, metric, v``) that have both methods, and Holm's adjustment within a family.

    Columns: n, the median difference, Hodges-Lehmann's estimate, Cliff's delta, paired dominance, p and p_holm. Only
    hypotheses of the role ``confirmatory`` count in the adjustment. What is collected is one number a data set.
    """
    side = lambda m, v: long.select("dataset", F.col("method").alias(m), "metric", F.col("v").alias(v))
    met = F.broadcast(families).join(side("method_a", "va"), ["metric", "method_a"]).join(side("method_b", "vb"), ["metric", "method_b", "dataset"])
    key = ["family", "hypothesis", "role", "metric", "method_a", "method_b"]
    listed = met.dropna("any", subset=["va", "vb"]).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("dataset", "va", "vb"))).alias("r"))
    diff = F.transform("r", lambda x: x["va"] - x["vb"])
    signs = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.signum(x))
    n = F.size("r").cast("double")
    walsh = F.flatten(F.transform("d", lambda x, i: F.transform(F.slice("d", i + 1, F.size("d")), lambda y: (x + y) / 2)))
    delta = F.aggregate("r", F.lit(0.0), lambda s, x: s + signs(F.transform("r", lambda y: x["va"] - y["vb"]))) / (n * n)
    tested = listed.withColumn("d", diff).select(
        *key, F.size("d").alias("n"), median_of(F.col("d")).alias("median"), median_of(walsh).alias("hodges_lehmann"), delta.alias("cliffs_delta"),
        (signs(F.col("d")) / n).alias("delta_pair"), sign_flip_column(F.col("d"), alternative, most, draws, seed).alias("p"),
    )
    every = F.broadcast(families).select(*key).join(tested, key, "left").withColumn("counted", F.when(F.col("role") == "confirmatory", F.col("p")))
    return holm(every, "family", "counted", "hypothesis").drop("counted")


def median_of(values: Column) -> Column:
    """Median of an array of doubles; NULL if it is empty."""
    s = F.sort_array(values)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def experiment_statistics(results: DataFrame, metric: str, lower_is_better: bool = True, level: float = 0.05) -> DataFrame:
    """One row a method with its average rank, and the experiment's Friedman test and critical difference beside it."""
    w = medians(results, metric)
    ranked = average_ranks(w, lower_is_better)
    test = friedman(w).withColumnsRenamed({"n": "n_datasets", "k": "n_methods"})
    return ranked.drop("n").crossJoin(F.broadcast(test)).crossJoin(F.broadcast(critical_difference(ranked, level).select("cd")))


def reproduces(computed: DataFrame, reference: DataFrame, keys: list[str], column: str, relative: float, absolute: float) -> DataFrame:
    """``keys, computed, reference, ok``: whether values agree within the larger of a relative and an absolute tolerance.

    A value that one side lacks isn't reproduced.
    """
    a, b = computed.select(*keys, F.col(column).alias("computed")), reference.select(*keys, F.col(column).alias("reference"))
    near = F.abs(F.col("computed") - F.col("reference")) <= F.greatest(F.lit(relative) * F.abs(F.col("reference")), F.lit(absolute))
    return a.join(b, keys, "full_outer").withColumn("ok", F.coalesce(near, F.lit(False)))


def equivalent_starts(results: DataFrame, variant: str, a: str, b: str, keys: list[str], metric: str) -> DataFrame:
    """How far two variants of the same runs are apart: ``n, median, largest`` of the absolute differences of runs both have."""
    p = results.filter(F.col(variant).isin(a, b)).groupBy(*keys).agg(*[F.max(F.when(F.col(variant) == x, F.col(metric))).alias(n) for x, n in ((a, "va"), (b, "vb"))]).dropna("any", subset=["va", "vb"])
    gap = F.abs(F.col("va") - F.col("vb"))
    return p.agg(F.count(F.lit(1)).alias("n"), F.median(gap).alias("median"), F.max(gap).alias("largest"))


def dominated_by(points: DataFrame, group: str, item: str, family: str, name: str, m1: str, m2: str) -> DataFrame:
    """``group, item, dominated``: whether a row of the family ``name`` is at least as large in both metrics and larger in one.

    One ordered pass as for the front, with only the family's rows as candidates; NULLs are never dominated.
    """
    p = points.withColumn("_c", F.when((F.col(family) == name) & F.col(m1).isNotNull(), F.col(m2)))
    at_least = F.max("_c").over(Window.partitionBy(group).orderBy(F.desc(m1)).rangeBetween(Window.unboundedPreceding, 0))
    same = F.max("_c").over(Window.partitionBy(group, m1))
    top = p.groupBy(group, m1).agg(F.max("_c").alias("_t")).withColumn("_above", F.max("_t").over(Window.partitionBy(group).orderBy(F.desc(m1)).rowsBetween(Window.unboundedPreceding, -1))).drop("_t")
    q = p.withColumn("_least", at_least).withColumn("_same", same).join(top, [group, m1], "left")
    beaten = (F.col("_above") >= F.col(m2)) | (F.col("_same") > F.col(m2))
    return q.select(group, item, F.coalesce(beaten, F.lit(False)).alias("dominated"))


def strongest_property(units: DataFrame, key: str, target: str, properties: list[str]) -> DataFrame:
    """``property, rho, n, strongest``: Spearman of each property with the target over the units that have both; the one with
    the largest absolute value is the strongest, the first by name on ties."""
    long = units.select(key, target, *[F.col(c).cast("double").alias(c) for c in properties]).unpivot([key, target], properties, "property", "x").dropna("any", subset=[target, "x"])
    r = long.withColumn("rx", average_rank("x", "property")).withColumn("ry", average_rank(target, "property"))
    rho = r.groupBy("property").agg(pearson("rx", "ry").alias("rho"), F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.orderBy(F.abs("rho").desc_nulls_last(), "property")) == 1
    return rho.withColumn("strongest", first)


def panel_medians(results: DataFrame, metrics: list[str], panels: dict[str, Column]) -> DataFrame:
    """``panel, n`` and the medians of the metrics of the rows that each panel's condition selects; a row may be in several."""
    named = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in panels.items()]))
    rows = results.withColumn("panel", F.explode(named))
    return rows.groupBy("panel").agg(F.count(F.lit(1)).alias("n"), *[F.median(m).alias(m) for m in metrics])


def against_baseline(results: DataFrame, metric: str, level: str, baseline: float, alternative: str = "greater") -> DataFrame:
    """For each other level: the differences of the data sets' medians to those at the baseline, summed up and tested."""
    m = results.groupBy("dataset", level).agg(F.median(metric).alias("v"))
    base = m.filter(F.col(level) == baseline).select("dataset", F.col("v").alias("base"))
    d = m.filter(F.col(level) != baseline).join(base, "dataset").withColumn("diff", F.col("v") - F.col("base"))
    listed = d.groupBy(level).agg(F.transform(F.sort_array(F.collect_list(F.struct("dataset", "diff"))), lambda r: r["diff"]).alias("d"))
    share = F.size(F.filter("d", lambda x: x > 0)) / F.size("d")
    return listed.select(level, F.size("d").alias("n"), median_of(F.col("d")).alias("median"), share.alias("share_positive"), sign_flip_column(F.col("d"), alternative).alias("p"))


def holm(tests: DataFrame, family: str, p: str, order: str) -> DataFrame:
    """Holm's step-down adjustment within families; tests without a p value don't count and stay NULL."""
    w = Window.partitionBy(family).orderBy(F.col(p).asc_nulls_last(), order)
    m = F.count(p).over(Window.partitionBy(family))
    step = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p)))
    stepped = tests.withColumn("step", step)
    running = F.max("step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("p_holm", F.when(F.col(p).isNotNull(), running)).drop("step")


def hodges_lehmann(pairs: DataFrame) -> DataFrame:
    """Median of the Walsh averages of the differences, which meet by pairs of blocks of data sets."""
    d = pairs.select(F.lit(0).alias("one"), "dataset", "diff")
    walsh = within(d, "one", "dataset", "diff").select(((F.col("diff") + F.col("diff2")) / 2).alias("w")).unionAll(d.select("diff"))
    return walsh.agg(F.median("w").alias("hodges_lehmann"))


def cliffs_delta(wide: DataFrame, a: str, b: str) -> DataFrame:
    """Share of pairs in which a's value is larger less the share in which it is smaller, from ranks of the union."""
    both = wide.filter(F.col("method").isin(a, b)).withColumn("rank", average_rank("v"))
    s = both.agg(F.sum(F.when(F.col("method") == a, F.col("rank"))).alias("ra"), F.count_if(F.col("method") == a).alias("na"), F.count_if(F.col("method") == b).alias("nb"))
    u = F.col("ra") - F.col("na") * (F.col("na") + 1) / 2.0
    return s.select((2 * u / (F.col("na") * F.col("nb")) - 1).alias("delta"))


def summary(pairs: DataFrame) -> DataFrame:
    """Median, mean, sd, median absolute deviation, robust sigma and the share above zero of the differences."""
    m = pairs.agg(F.median("diff").alias("median"))
    dev = pairs.crossJoin(F.broadcast(m))
    out = dev.agg(F.max("median").alias("median"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("sd"), F.median(F.abs(F.col("diff") - F.col("median"))).alias("mad"), F.avg((F.col("diff") > 0).cast("double")).alias("share_positive"))
    return out.withColumn("robust_sigma", 1.4826 * F.col("mad"))


def tost(pairs: DataFrame, margin: float) -> DataFrame:
    """Equivalence within the margin: the larger of two one-sided t tests' p values."""
    s = pairs.agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("sd"))
    t = lambda m: ratio(F.col("mean") - m, F.col("sd") / F.sqrt("n"))
    return s.withColumn("p", F.greatest(dist.t_sf(t(-margin), F.col("n") - 1), dist.t_sf(-t(margin), F.col("n") - 1)))


def correlations(long: DataFrame, unit: str, metric: str, value: str) -> DataFrame:
    """Spearman correlation of each pair of metrics over the units that have both, with their number."""
    a = long.select(unit, F.col(metric).alias("a"), F.col(value).alias("va"))
    b = long.select(unit, F.col(metric).alias("b"), F.col(value).alias("vb"))
    j = a.join(b, unit).filter("a < b and va is not null and vb is not null")
    j = j.withColumn("ra", average_rank("va", "a", "b")).withColumn("rb", average_rank("vb", "a", "b"))
    return j.groupBy("a", "b").agg(pearson("ra", "rb").alias("rho"), F.count(F.lit(1)).alias("n"))


def within_group_spearman(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Spearman within each group that has at least three different x."""
    r = df.dropna("any", subset=[x, y]).withColumn("rx", average_rank(x, group)).withColumn("ry", average_rank(y, group))
    return r.groupBy(group).agg(pearson("rx", "ry").alias("rho"), F.count_distinct(x).alias("k")).filter("k >= 3").select(group, "rho")


def sign_summary(df: DataFrame, column: str) -> DataFrame:
    """``n, median, low, high, positive`` of a column, and the exact two-sided sign test's p over its non-zero values."""
    s = df.agg(F.count(column).alias("n"), F.median(column).alias("median"), F.min(column).alias("low"), F.max(column).alias("high"), F.count_if(F.col(column) > 0).alias("positive"), F.count_if(F.col(column) != 0).alias("m"))
    return s.withColumn("p", dist.binomial_two_sided(F.col("positive"), F.col("m"))).drop("m")


def first_of_equal(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first row, by ``order``, of the rows that agree in ``columns``, vectors included."""
    first = F.row_number().over(Window.partitionBy(*columns).orderBy(order))
    return df.withColumn("_p", first).filter("_p = 1").drop("_p")


def evenly_spaced(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The rows at ``n`` evenly spaced places of an order, ends included, with their ``place`` from 0.

    Places come from counts by bands of the first column, so that only the bands with a wanted place are ordered.
    """
    total = df.count()
    want = sorted({round(k * (total - 1) / max(n - 1, 1)) for k in range(n)}) if total else []
    bands = df.groupBy(F.col(order[0]).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    before = bands.withColumn("_b", F.sum("_c").over(Window.orderBy(F.col("_v").asc_nulls_first())) - F.col("_c"))
    held = before.filter(F.exists(F.array(*[F.lit(w) for w in want]).cast("array<long>"), lambda w: (w >= F.col("_b")) & (w < F.col("_b") + F.col("_c"))))
    rows = df.join(held, F.col(order[0]).eqNullSafe(F.col("_v")))
    placed = rows.withColumn("place", F.col("_b") + F.row_number().over(Window.partitionBy("_v").orderBy(*order)) - 1)
    return placed.filter(F.col("place").isin(want)).drop("_v", "_c", "_b")


def converged(pairs: DataFrame, final: str, reference: str, factor: float = 1.5) -> DataFrame:
    """``dataset, ratio, converged``: whether a final stress stays below ``factor`` times the reference's."""
    return pairs.select("dataset", ratio(F.col(final), F.col(reference)).alias("ratio"), (F.col(final) < factor * F.col(reference)).alias("converged"))


def approximation_gap(stresses: DataFrame, seconds: DataFrame) -> DataFrame:
    """``dataset, gap, speed_up`` of an approximation (a) against the full form (b): relative stress and quotient of times."""
    t = seconds.select("dataset", F.col("va").alias("ta"), F.col("vb").alias("tb"))
    return stresses.join(t, "dataset").select("dataset", ratio(F.col("va") - F.col("vb"), F.col("vb")).alias("gap"), ratio(F.col("tb"), F.col("ta")).alias("speed_up"))


def bootstrap_median(pairs: DataFrame, draws: int, seed: int, level: float = 0.95) -> DataFrame:
    """Percentile interval of the median difference; draws index the rows by hashes, so reruns agree."""
    rows = pairs.withColumn("o", F.row_number().over(Window.orderBy("dataset")) - 1).select("o", "diff")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    grid = pairs.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(n)).select("draw", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    picked = grid.select("draw", F.pmod(F.xxhash64("draw", "k", F.lit(seed)), F.col("n")).alias("o")).join(F.broadcast(rows), "o")
    tail = (1 - level) / 2
    med = picked.groupBy("draw").agg(F.median("diff").alias("m"))
    return med.agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))


def regime(ratio_col: Column, t1: float, t2: float) -> Column:
    """Three bands of the log ratio."""
    v = F.log(ratio_col)
    return F.when(v < t1, "low").when(v < t2, "middle").otherwise("high")


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks that have no finished row yet."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")
