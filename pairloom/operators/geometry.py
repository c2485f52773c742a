"""Pairs of points, neighbour ranks, and the metrics that compare a map with its input.

``pairs`` has one row for i < j with the distances ``d_hi`` (input) and ``d_lo`` (map). Metrics are aggregates over it;
nothing collects it. Missing values are NULL, never NaN.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tiles
from .lineage import cut_lineage

BLOCK = tiles.BLOCK


def pairs(points: DataFrame, block: int = BLOCK, extra: str | None = None) -> DataFrame:
    """All pairs i < j of ``id, x, y, label`` points: ``i, j, d_hi, d_lo, ci, cj``.

    Points are packed into blocks, whose number is bounded, and pairs of blocks meet in a task that holds two (``tiles``). ``extra`` names one more column
    of coordinates, whose distances come as ``d_ref``. A point without a label gives NULL; any number is a label.
    """
    names = ["i", "j", "d_hi", "d_lo", "ci", "cj"] + (["d_ref"] if extra else [])

    def rows(tile):
        (a, b), labels, none = tile.ids, tile.labels, tile.none
        for part in tile.parts(tiles.differences, 256, 256):
            p, q = np.nonzero(np.ones(part.d[0].shape, bool) if part.keep is None else part.keep)
            d = [m[p, q] for m in part.d]
            p, q = p + part.rows.start, q + part.columns.start
            swap = a[p] > b[q]
            i, j = np.where(swap, b[q], a[p]), np.where(swap, a[p], b[q])
            first, second = np.where(swap, labels[1][q], labels[0][p]), np.where(swap, labels[0][p], labels[1][q])
            none1, none2 = np.where(swap, none[1][q], none[0][p]), np.where(swap, none[0][p], none[1][q])
            cols = [pa.array(i), pa.array(j), pa.array(d[0]), pa.array(d[1]), pa.array(first.astype(np.int32), mask=none1), pa.array(second.astype(np.int32), mask=none2)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(m) for m in d[2:]], names=names)

    schema = "i long, j long, d_hi double, d_lo double, ci int, cj int" + (", d_ref double" if extra else "")
    return tiles.over(points, rows, schema, ("x", "y", extra) if extra else ("x", "y"), block)


def within(rows: DataFrame, by: str, item: str, *values: str, block: int = 512) -> DataFrame:
    """Each pair of the rows of a ``by`` once, as ``by, item, values, item2, values2``.

    Rows are dealt to blocks of about ``block`` and meet by pairs of blocks, so that a large group is the work of many
    tasks: what is shuffled is each row once for every block of its group, not each pair.
    """
    n = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    dealt = rows.select(by, item, *values).join(n, by).withColumn("_b", F.pmod(F.xxhash64(item), "_blocks").cast("int"))
    left = dealt.withColumn("_p", F.col("_b")).withColumn("_q", F.explode(F.sequence("_b", F.col("_blocks") - 1))).drop("_blocks", "_b")
    right = dealt.withColumn("_q", F.col("_b")).withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_b"))))
    right = right.select(by, "_p", "_q", *[F.col(c).alias(f"{c}2") for c in (item, *values)])
    met = left.join(right, [by, "_p", "_q"]).filter((F.col("_p") < F.col("_q")) | (F.col(item) < F.col(f"{item}2")))
    return met.drop("_p", "_q")


def both_ways(p: DataFrame) -> DataFrame:
    """Each pair in both directions."""
    swapped = p.select(F.col("j").alias("i"), F.col("i").alias("j"), "d_hi", "d_lo", F.col("cj").alias("ci"), F.col("ci").alias("cj"))
    return p.select("i", "j", "d_hi", "d_lo", "ci", "cj").unionAll(swapped)


def ranks(p: DataFrame) -> DataFrame:
    """Ordered pairs with ``r`` (input) and ``q`` (map), the neighbour ranks from 1; ties go by the other point's id."""
    hi, lo = (Window.partitionBy("i").orderBy(d, "j") for d in ("d_hi", "d_lo"))
    return both_ways(p).withColumn("r", F.row_number().over(hi)).withColumn("q", F.row_number().over(lo))


def knn(p: DataFrame, k: int, space: str = "d_hi") -> DataFrame:
    """``i, j, rank`` of the k nearest; the rank filter reaches the window as a group limit."""
    w = Window.partitionBy("i").orderBy(space, "j")
    return both_ways(p).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def pearson(a: str, b: str) -> Column:
    """Correlation as an aggregate; NULL where a side is constant."""
    return ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_rank(column: str, *partition: str) -> Column:
    """Rank from 1, ties sharing the mean of their places."""
    order = Window.partitionBy(*partition).orderBy(column)
    return F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, column)) - 1).cast("double") / 2


def stress(p: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Scale-invariant, relative (by input distance) and Kruskal stress and the optimal scale, in one pass."""
    hl, ll, hh = F.sum(F.col("d_hi") * F.col("d_lo")), F.sum(F.col("d_lo") ** 2), F.sum(F.col("d_hi") ** 2)
    gap = (F.col("d_hi") - F.col("d_lo")) ** 2
    relative = ratio(F.sum(gap / F.greatest("d_hi", F.lit(eps))), F.sum("d_hi"))
    return p.agg(
        (1 - ratio(hl * hl, hh * ll)).alias("scale_invariant"), ratio(hl, ll).alias("scale"), relative.alias("relative"),
        F.sqrt(ratio(F.sum(gap), ll)).alias("kruskal"), F.count(F.lit(1)).alias("n_pairs"),
    )


def shepard(p: DataFrame) -> DataFrame:
    """Pearson and Spearman correlation of the two distances over all pairs."""
    out = global_ranks(p.select("d_hi", "d_lo"), {"d_hi": "rh", "d_lo": "rl"})
    return out.agg(pearson("d_hi", "d_lo").alias("pearson"), pearson("rh", "rl").alias("spearman"))


def global_ranks(p: DataFrame, names: dict[str, str], bands: int = 4096) -> DataFrame:
    """``p`` with the average rank of each named column over the whole table, a shuffle a column and no sort in one task.

    Values fall into bands of equal width; ranks within a band come from a window, those of earlier bands are counted
    beforehand, for all columns at once. A value that many rows share is one band's and is spilled there.
    """
    columns = list(names)
    ends = p.agg(*[f(c).alias(f"{c}_{k}") for c in columns for k, f in (("low", F.min), ("high", F.max))]).first()

    def band(c: str) -> Column:
        width = ((ends[f"{c}_high"] or 0.0) - (ends[f"{c}_low"] or 0.0)) / bands
        return F.lit(0) if not width else F.least(F.lit(bands - 1), F.floor((F.col(c) - F.lit(ends[f"{c}_low"])) / F.lit(width))).cast("int")

    met = p.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), band(c).alias("_band")) for k, c in enumerate(columns)])).alias("b"))
    counts = cut_lineage(met.groupBy("b.k", "b._band").agg(F.count(F.lit(1)).alias("c")))  # at most ``bands`` rows a column
    before = counts.withColumn("_before", F.sum("c").over(Window.partitionBy("k").orderBy("_band")) - F.col("c"))
    for k, (c, name) in enumerate(names.items()):
        offset = before.filter(F.col("k") == k).select("_band", "_before")
        p = p.withColumn("_band", band(c)).join(F.broadcast(offset), "_band", "left").withColumn(name, average_rank(c, "_band") + F.coalesce("_before", F.lit(0))).drop("_band", "_before")
    return p


def global_rank(p: DataFrame, column: str, name: str, bands: int = 4096) -> DataFrame:
    return global_ranks(p, {column: name}, bands)


def trust_continuity(r: DataFrame, k: int) -> DataFrame:
    """Trustworthiness and continuity; NULL where 2n - 3k - 1 <= 0."""
    n = F.count_distinct("i")
    late = lambda near, far: F.sum(F.when((F.col(near) <= k) & (F.col(far) > k), F.col(far) - k).otherwise(0))
    norm = n * k * (2 * n - 3 * k - 1)
    value = lambda s: F.when(2 * n - 3 * k - 1 > 0, 1 - ratio(2.0 * s, norm.cast("double")))
    return r.agg(F.lit(k).alias("k"), value(late("q", "r")).alias("trustworthiness"), value(late("r", "q")).alias("continuity"))


def qnx_curve(r: DataFrame) -> DataFrame:
    """``k, qnx, rnx`` for k = 1 .. n-1: shares of kept neighbours, and the gain over a random map (NULL at n-1).

    A pair is kept at all k from the larger of its ranks on, so a histogram and a running sum do.
    """
    n = r.agg((F.max("r") + 1).alias("n"))
    hist = r.groupBy(F.greatest("r", "q").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    every = n.select("n", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    kept = F.sum(F.coalesce("c", F.lit(0))).over(Window.orderBy("k"))
    curve = every.join(hist, "k", "left").select("n", "k", (kept / (F.col("k") * F.col("n")).cast("double")).alias("qnx"))
    gain = ratio((F.col("n") - 1) * F.col("qnx") - F.col("k"), (F.col("n") - 1 - F.col("k")).cast("double"))
    return curve.withColumn("rnx", gain)


def auc_rnx(curve: DataFrame) -> DataFrame:
    """Mean gain with weights 1 / k."""
    defined = F.col("rnx").isNotNull()
    return curve.agg(ratio(F.sum(F.col("rnx") / F.col("k")), F.sum(F.when(defined, 1.0 / F.col("k")))).alias("auc_rnx"))


def local_global(curve: DataFrame) -> DataFrame:
    """K* with the largest local continuity (first on ties), and the mean gain up to it and beyond."""
    lcmc = F.col("qnx") - F.col("k") / (F.col("n") - 1)
    best = curve.withColumn("lcmc", lcmc).withColumn("place", F.row_number().over(Window.orderBy(F.desc("lcmc"), "k"))).filter("place = 1").select(F.col("k").alias("k_star"), F.col("lcmc").alias("lcmc_star"))
    inside = F.col("k") <= F.col("k_star")
    return curve.crossJoin(F.broadcast(best)).agg(
        F.max("k_star").alias("k_star"), F.max("lcmc_star").alias("lcmc"), F.avg(F.when(inside, F.col("rnx"))).alias("q_local"), F.avg(F.when(~inside, F.col("rnx"))).alias("q_global"),
    )


def overlap(r: DataFrame, k: int) -> DataFrame:
    """Mean Jaccard index and mean number of common neighbours among the k nearest of both spaces."""
    per = r.groupBy("i").agg(F.count_if((F.col("r") <= k) & (F.col("q") <= k)).alias("m"))
    return per.agg(F.avg(F.col("m") / (2.0 * k - F.col("m"))).alias("jaccard"), F.avg("m").alias("common"))


def neighborhood_hit(r: DataFrame, k: int) -> DataFrame:
    """Share of the k nearest in the map that have the point's own label."""
    return r.filter(F.col("q") <= k).agg(F.avg((F.col("ci") == F.col("cj")).cast("double")).alias("hit"))


def coranking(r: DataFrame) -> DataFrame:
    return r.groupBy("r", "q").agg(F.count(F.lit(1)).alias("n"))


def distance_correlation(p: DataFrame) -> DataFrame:
    """Distance correlation from row means: mean(AB) = mean(Dd) - 2 mean(row means' product) + product of means."""
    s = both_ways(p)
    n = F.count_distinct("i").cast("double")
    rows = s.groupBy("i").agg(F.sum("d_hi").alias("a"), F.sum("d_lo").alias("b"))
    m = rows.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") ** 2).alias("aa"), F.sum(F.col("b") ** 2).alias("bb"))
    t = s.agg(F.sum(F.col("d_hi") * F.col("d_lo")).alias("tab"), F.sum(F.col("d_hi") ** 2).alias("taa"), F.sum(F.col("d_lo") ** 2).alias("tbb"))
    n = F.col("n")
    cov = lambda tt, rr, x, y: F.col(tt) / n**2 - 2 * F.col(rr) / n**3 + F.col(x) * F.col(y) / n**4
    both = m.crossJoin(F.broadcast(t))
    square = ratio(cov("tab", "ab", "sa", "sb"), F.sqrt(cov("taa", "aa", "sa", "sa") * cov("tbb", "bb", "sb", "sb")))
    return both.select(F.sqrt(F.greatest(square, F.lit(0.0))).alias("dcor"))


def double_centred(p: DataFrame) -> DataFrame:
    """Input distances less row and column means plus the grand mean, zero diagonal included in the means."""
    s = both_ways(p)
    rows = s.groupBy("i").agg(F.sum("d_hi").alias("a"))
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("t"))
    means = rows.crossJoin(F.broadcast(n)).select("i", (F.col("a") / F.col("n")).alias("m"), (F.col("t") / F.col("n") ** 2).alias("g"))
    other = means.select(F.col("i").alias("j"), F.col("m").alias("mj"))
    return p.select("i", "j", "d_hi").join(means, "i").join(other, "j").select("i", "j", (F.col("d_hi") - F.col("m") - F.col("mj") + F.col("g")).alias("centred"))


def silhouette(p: DataFrame, space: str = "d_lo") -> DataFrame:
    """Mean silhouette of the labelled points; one alone in its class, or with no distance at all, counts 0.

    NULL unless there are at least two classes and fewer classes than points.
    """
    means = both_ways(p).filter(F.col("ci").isNotNull() & F.col("cj").isNotNull()).groupBy("i", "ci", "cj").agg(F.avg(space).alias("m"))
    per = means.groupBy("i", "ci").agg(F.min(F.when(F.col("ci") == F.col("cj"), F.col("m"))).alias("a"), F.min(F.when(F.col("ci") != F.col("cj"), F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce(ratio(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    classes, points = F.count_distinct("ci"), F.count(F.lit(1))
    return per.agg(F.when((classes >= 2) & (classes < points), F.avg(s)).alias("silhouette"))


def centroids(points: DataFrame, column: str = "y", dims: int = 2) -> DataFrame:
    return points.groupBy("label").agg(F.array(*[F.avg(F.col(column)[k]) for k in range(dims)]).alias("c"))


def euclid(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))


def distance_consistency(points: DataFrame) -> DataFrame:
    """Share of points whose nearest class centroid in the map is their own class's (the smaller label on ties)."""
    near = points.crossJoin(F.broadcast(centroids(points).withColumnRenamed("label", "k"))).withColumn("d", euclid("y", "c"))
    best = near.groupBy("id", "label").agg(F.min(F.struct("d", "k")).alias("m"))
    return best.agg(F.avg((F.col("m.k") == F.col("label")).cast("double")).alias("distance_consistency"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    """Mean over classes of the worst (spread + spread) / distance of centroids, in the map."""
    c = centroids(points)
    spread = points.join(F.broadcast(c), "label").groupBy("label", "c").agg(F.avg(euclid("y", "c")).alias("s"))
    other = spread.select(F.col("label").alias("l2"), F.col("c").alias("c2"), F.col("s").alias("s2"))
    worst = spread.join(F.broadcast(other), F.col("label") != F.col("l2")).groupBy("label").agg(F.max(ratio(F.col("s") + F.col("s2"), euclid("c", "c2"))).alias("w"))
    return worst.agg(F.avg("w").alias("davies_bouldin"))


def class_means(p: DataFrame) -> DataFrame:
    """Mean distances between classes ``ca < cb``, input and map."""
    q = p.filter(F.col("ci") != F.col("cj"))
    return q.groupBy(F.least("ci", "cj").alias("ca"), F.greatest("ci", "cj").alias("cb")).agg(F.avg("d_hi").alias("hi"), F.avg("d_lo").alias("lo"))


def class_spread(p: DataFrame) -> DataFrame:
    """Median distance within each class, input and map."""
    return p.filter(F.col("ci") == F.col("cj")).groupBy(F.col("ci").alias("label")).agg(F.median("d_hi").alias("hi"), F.median("d_lo").alias("lo"))


def rank_correlation(df: DataFrame, a: str, b: str, least: int = 0) -> DataFrame:
    """Spearman correlation of two columns of a small table; NULL where one is constant or below ``least`` rows."""
    rho = df.dropna("any", subset=[a, b]).withColumn("ra", average_rank(a)).withColumn("rb", average_rank(b))
    return rho.agg(F.when(F.count(F.lit(1)) >= least, pearson("ra", "rb")).alias("spearman"))


#: Classes that class geometry is defined for. Fixed values.
LEAST_CLASSES, MOST_CLASSES = 3, 50


class Classes:
    """What class geometry needs of a pair table, each made at most once: a row a pair of classes, a class, and one."""

    def __init__(self, p: DataFrame | None, made: dict[str, DataFrame] | None = None):
        self.p = p
        self._made: dict[str, DataFrame] = dict(made or {})

    def __getattr__(self, name: str) -> DataFrame:
        if name not in ("means", "spread", "number", "whole"):
            raise AttributeError(name)
        if name not in self._made:
            if name == "whole":  # the medians of all distances
                made = exact_median(self.p, "d_hi").withColumnRenamed("median", "all_hi").crossJoin(exact_median(self.p, "d_lo").withColumnRenamed("median", "all_lo"))
            elif name == "number":  # with two points or more, a class is in a pair of classes or has a spread
                every = self.means.select("ca").unionAll(self.means.select("cb")).unionAll(self.spread.select("label"))
                made = every.agg(F.count_distinct("ca").cast("long").alias("n_classes"))
            else:
                made = {"means": class_means, "spread": class_spread}[name](self.p)
            self._made[name] = cut_lineage(made)
        return self._made[name]


def _classes(p: DataFrame | Classes) -> Classes:
    return p if isinstance(p, Classes) else Classes(p)


def _if_classes(df: DataFrame, c: Classes, column: str) -> DataFrame:
    known = F.col("n_classes").between(LEAST_CLASSES, MOST_CLASSES)
    return df.crossJoin(F.broadcast(c.number)).select(F.when(known, F.col(column)).alias(column))


def centroid_spearman(p: DataFrame | Classes) -> DataFrame:
    """Spearman of the mean distances between classes; NULL below three classes or above fifty."""
    c = _classes(p)
    return _if_classes(rank_correlation(c.means, "hi", "lo", 3), c, "spearman")


def spread_spearman(p: DataFrame | Classes) -> DataFrame:
    """Spearman of the median distances within classes; NULL below three classes with two points, or above fifty."""
    c = _classes(p)
    return _if_classes(rank_correlation(c.spread, "hi", "lo", 3), c, "spearman")


def lie_factor(p: DataFrame | Classes) -> DataFrame:
    """Median over classes of the absolute log ratio of spreads, each over the median of all distances of its space.

    Classes without spread on a side are left out; NULL below three classes or above fifty.
    """
    c = _classes(p)
    spread = c.spread.filter("hi > 0 and lo > 0").crossJoin(F.broadcast(c.whole)).filter("all_hi > 0 and all_lo > 0")
    change = F.log((F.col("lo") / F.col("all_lo")) / (F.col("hi") / F.col("all_hi")))
    return _if_classes(spread.agg(F.median(F.abs(change)).alias("lie_factor")), c, "lie_factor")


def class_neighbours_kept(p: DataFrame | Classes, k: int = 3) -> DataFrame:
    """Share of classes whose set of k nearest classes is the same in both spaces; NULL below k + 1 classes or above fifty."""
    c = _classes(p)
    means = c.means
    s = means.select("ca", "cb", "hi", "lo").unionAll(means.select(F.col("cb"), F.col("ca"), "hi", "lo"))
    rank = lambda d: F.row_number().over(Window.partitionBy("ca").orderBy(d, "cb"))
    per = s.withColumn("r", rank("hi")).withColumn("q", rank("lo")).groupBy("ca").agg(F.count_if((F.col("r") <= k) & (F.col("q") <= k)).alias("m"))
    kept = per.agg(F.when(F.count(F.lit(1)) > k, F.avg((F.col("m") == k).cast("double"))).alias("preserved"))
    return _if_classes(kept, c, "preserved")


ANSWERS = "question string, n_classes long, note string, n_candidates long, true_answer string, pred_answer string, correct int, soft_rho double, tie_in_truth boolean, tie_in_prediction boolean"


def discovery(p: DataFrame | Classes, tolerance: float = 1e-9) -> DataFrame:
    """Two questions answered in both spaces: the nearest pair of classes, and the class with the largest spread.

    A row a question, with the columns of ``ANSWERS``: where there are too few or too many classes, or fewer than two
    with a spread, the answers are NULL and the note says why. A tie is a runner-up within ``tolerance`` of the best.
    """
    classes = _classes(p)
    means = classes.means.select(F.concat_ws("|", "ca", "cb").alias("answer"), F.col("ca").alias("o1"), F.col("cb").alias("o2"), "hi", "lo")
    spread = classes.spread.select(F.col("label").cast("string").alias("answer"), F.col("label").alias("o1"), F.lit(0).alias("o2"), "hi", "lo")

    def best(candidates: DataFrame, d: str, sign: int, names: tuple[str, str]) -> DataFrame:
        top = candidates.withColumn("v", sign * F.col(d)).orderBy("v", "o1", "o2").limit(2)
        two = top.agg(F.sort_array(F.collect_list(F.struct("v", "o1", "o2", "answer"))).alias("t"), F.count(F.lit(1)).alias("n"))
        gap = F.abs(F.col("t")[1]["v"] - F.col("t")[0]["v"]) <= tolerance * F.greatest(F.abs(F.col("t")[0]["v"]), F.lit(1e-12))
        return two.select(F.get("t", F.lit(0))["answer"].alias(names[0]), F.when(F.col("n") > 1, gap).otherwise(F.lit(False)).alias(names[1]))

    def row(question: str, candidates: DataFrame, sign: int, rho: DataFrame, least: int) -> DataFrame:
        n = candidates.agg(F.count(F.lit(1)).alias("n_candidates"))
        both = classes.number.crossJoin(n).crossJoin(best(candidates, "hi", sign, ("true_answer", "tie_in_truth"))).crossJoin(best(candidates, "lo", sign, ("pred_answer", "tie_in_prediction"))).crossJoin(rho.withColumnRenamed("spearman", "soft_rho"))
        note = F.when(F.col("n_classes") < LEAST_CLASSES, "insufficient_classes_or_no_labels").when(F.col("n_classes") > MOST_CLASSES, "excessive_classes_likely_continuous_label").when(F.col("n_candidates") < least, "fewer_than_2_classes_with_2plus_points").otherwise("")
        both = both.withColumn("question", F.lit(question)).withColumn("note", note).withColumn("correct", (F.col("true_answer") == F.col("pred_answer")).cast("int"))
        names = [x.split()[0] for x in ANSWERS.split(", ")]
        return both.select(*[F.col(c) if c in ("question", "n_classes", "note") else F.when(F.col("note") == "", F.col(c)).alias(c) for c in names])

    return row("nearest_class_pair", means, 1, centroid_spearman(classes), 1).unionByName(row("most_dispersed_class", spread, -1, spread_spearman(classes), 2))


def estimate_eps(points: DataFrame, k: int = 5, q: float = 0.1) -> DataFrame:
    """``eps``: the ``q`` quantile over all points of the distance to the k-th nearest neighbour; an error if it is 0."""
    at = nearest(points, k).filter(F.col("rank") == k)
    found = at.agg(F.percentile("d_hi", q).alias("eps"))
    wrong = F.raise_error(F.lit("too many points have no distance to their neighbours, or there are too few points")).cast("double")
    return found.select(F.when(F.col("eps") > 0, F.col("eps")).otherwise(wrong).alias("eps"))


def properties(points: DataFrame, k_mle: int = 10, k_hub: int = 10, fraction: float = 0.9, eps: float = 1e-9) -> DataFrame:
    """Properties of the input distances: neighbour ratios, spread, contrast, two intrinsic dimensions, hubness, silhouette."""
    if "y" in points.columns and points.limit(2).count() > 1 and fits_broadcast(points):
        from . import measures

        return measures.properties(points, k_mle, k_hub, fraction, eps)
    p = pairs(points)
    med = exact_median(p, "d_hi").withColumnRenamed("median", "med")
    every = p.agg(F.avg("d_hi").alias("mean"), F.stddev_pop("d_hi").alias("sd"), F.skewness("d_hi").alias("dist_skew")).crossJoin(med)
    near = nearest(points, max(k_mle, k_hub))
    ends = both_ways(p).groupBy("i").agg(F.min("d_hi").alias("lo"), F.max("d_hi").alias("hi"))
    contrast = ends.agg(F.median((F.col("hi") - F.col("lo")) / F.greatest("lo", F.lit(eps))).alias("relative_contrast"), F.count(F.lit(1)).alias("n"))
    kth = lambda k: F.median(F.when(F.col("rank") == k, F.col("d_hi")))
    ratios = near.agg(kth(1).alias("k1"), kth(5).alias("k5"), kth(10).alias("k10"))
    row = every.crossJoin(contrast).crossJoin(ratios)
    ids = points.select(F.col("id").alias("j"))
    hub = ids.join(near.filter(F.col("rank") <= k_hub).groupBy("j").agg(F.count(F.lit(1)).alias("c")), "j", "left").agg(F.skewness(F.coalesce("c", F.lit(0)).cast("double")).alias("hubness_skew"))
    return (
        row.crossJoin(hub).crossJoin(two_nn(near, fraction)).crossJoin(mle_dimension(near, k_mle)).crossJoin(silhouette(p, "d_hi"))
        .select("n", (F.col("k1") / F.col("med")).alias("nn_ratio_k1"), (F.col("k5") / F.col("med")).alias("nn_ratio_k5"), (F.col("k10") / F.col("med")).alias("nn_ratio_k10"),
                (F.col("sd") / F.col("mean")).alias("dist_cv"), "dist_skew", "relative_contrast", "hubness_skew", "id_twonn", "id_mle", "silhouette")
    )


def two_nn(near: DataFrame, fraction: float, least: int = 10) -> DataFrame:
    """Intrinsic dimension from the ratio of the two nearest distances, by a regression through the origin.

    Only ratios above 1 count, the smallest ``fraction`` of them, rounded; NULL with fewer than ``least``.
    """
    first, second = (F.max(F.when(F.col("rank") == k, F.col("d_hi"))) for k in (1, 2))
    mu = near.groupBy("i").agg((second / F.greatest(first, F.lit(1e-300))).alias("mu")).filter((F.col("mu") > 1) & (F.col("mu") < float("inf")))
    every = Window.orderBy("mu", "i")
    f = mu.withColumn("place", F.row_number().over(every)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    b = -F.log(1 - F.least(F.col("place") / F.col("m"), F.lit(1.0 - 1e-12)))
    used = f.filter((F.col("m") >= least) & (F.col("place") <= F.greatest(F.lit(2), F.bround(F.col("m") * fraction)))).select(F.log("mu").alias("a"), b.alias("b"))
    return used.agg(ratio(F.sum(F.col("a") * F.col("b")), F.sum(F.col("a") ** 2)).alias("id_twonn"))


def mle_dimension(near: DataFrame, k: int) -> DataFrame:
    """Levina-Bickel estimate with k neighbours: the mean over points of their own estimates.

    A point whose k distances are all the same has none, and one with a neighbour in its own place has 0.
    """
    far = near.filter(F.col("rank") == k).select("i", F.col("d_hi").alias("t"))
    step = F.when(F.col("d_hi") > 0, F.log(F.col("t") / F.col("d_hi"))).when(F.col("t") > 0, F.lit(float("inf")))
    logs = near.filter(F.col("rank") < k).join(far, "i").groupBy("i").agg((F.sum(step) / (k - 1)).alias("mean"))
    return logs.filter("mean > 0").agg(F.avg(1.0 / F.col("mean")).alias("id_mle"))


def standardised(points: DataFrame) -> DataFrame:
    """``id, k, z``: every coordinate less its mean over its standard deviation; 0 where all values are the same."""
    c = points.select("id", F.posexplode("x").alias("k", "v"))
    m = c.groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = F.coalesce(ratio(F.col("v") - F.col("m"), F.col("s")), F.lit(0.0))
    return c.join(F.broadcast(m), "k").select("id", "k", z.alias("z"))  # a row a dimension


def weight(alpha: float, eps: float, d: str = "d_hi") -> Column:
    return F.lit(1.0) if alpha == 0 else F.pow(F.col(d) + eps, F.lit(-alpha))


def weighted_stress(p: DataFrame, alpha: float, eps: float) -> DataFrame:
    """sigma_alpha, its normalised form and the scale that minimises it."""
    w = weight(alpha, eps)
    gap = w * (F.col("d_hi") - F.col("d_lo")) ** 2
    return p.agg(
        F.lit(float(alpha)).alias("alpha"), F.sum(gap).alias("sigma"), ratio(F.sum(gap), F.sum(w * F.col("d_hi") ** 2)).alias("normalised"),
        ratio(F.sum(w * F.col("d_hi") * F.col("d_lo")), F.sum(w * F.col("d_lo") ** 2)).alias("scale"),
    )


def gradient(p: DataFrame, points: DataFrame, alpha: float, eps: float, floor: float = 1e-12) -> DataFrame:
    """Gradient of the weighted stress at each point of the map."""
    where = points.select(F.col("id").alias("i"), F.col("y").alias("yi"))
    other = points.select(F.col("id").alias("j"), F.col("y").alias("yj"))
    s = both_ways(p).join(where, "i").join(other, "j")
    c = -2.0 * weight(alpha, eps) * (F.col("d_hi") - F.col("d_lo")) / F.greatest("d_lo", F.lit(floor))
    return s.groupBy("i").agg(*[F.sum(c * (F.col("yi")[k] - F.col("yj")[k])).alias(n) for k, n in enumerate(("gx", "gy"))])


def diagonal_hessian(p: DataFrame, points: DataFrame, alpha: float, eps: float, floor: float = 1e-12) -> DataFrame:
    """Second derivatives of the weighted stress by each coordinate of each point of the map."""
    where = points.select(F.col("id").alias("i"), F.col("y").alias("yi"))
    other = points.select(F.col("id").alias("j"), F.col("y").alias("yj"))
    s = both_ways(p).join(where, "i").join(other, "j").withColumn("low", F.greatest("d_lo", F.lit(floor)))
    c = (F.col("d_hi") - F.col("d_lo")) / F.col("low")
    bend = lambda k: -2.0 * weight(alpha, eps) * (c - ((F.col("yi")[k] - F.col("yj")[k]) / F.col("low")) ** 2 * (1 + c))
    return s.groupBy("i").agg(F.sum(bend(0)).alias("hx"), F.sum(bend(1)).alias("hy"))


def block_residuals(p: DataFrame, theta: float, m: float) -> DataFrame:
    """Squared residuals of near (d <= theta), middle and far (d >= m) pairs."""
    gap = (F.col("d_hi") - F.col("d_lo")) ** 2
    near, far = F.col("d_hi") <= theta, F.col("d_hi") >= m
    part = lambda c: F.coalesce(F.sum(F.when(c, gap)), F.lit(0.0))
    return p.agg(part(near).alias("near"), part(~near & ~far).alias("mid"), part(far).alias("far"), F.count_if(near).alias("n_near"), F.count_if(far).alias("n_far"))


def weight_spread(p: DataFrame, alpha: float, eps: float, reliable: float = 12.0) -> DataFrame:
    """Coefficient of variation of the weights (exact, to first and to second order), their dynamic range in decades, and
    whether that is within what double precision carries."""
    w = weight(alpha, eps)
    u = F.log(F.col("d_hi") + eps)
    first = F.lit(float(alpha)) * F.stddev_pop(u)
    decades = F.lit(float(alpha)) * F.log10((F.max("d_hi") + eps) / (F.min("d_hi") + eps))
    return p.agg(
        ratio(F.stddev_pop(w), F.avg(w)).alias("cv_exact"), first.alias("cv_first_order"), (first * (1 - F.coalesce(F.skewness(u), F.lit(0.0)) * first / 2)).alias("cv_second_order"),
        decades.alias("range_log10"), (decades <= reliable).alias("reliable"),
    )


def log_distance_moments(p: DataFrame, eps: float) -> DataFrame:
    """Mean, deviation, skewness and excess kurtosis of the logarithms of the distances; the last two 0 if all are equal."""
    u = F.log(F.col("d_hi") + eps)
    some = F.stddev_pop(u) > 0
    return p.agg(F.avg(u).alias("mean"), F.stddev_pop(u).alias("sd"), F.when(some, F.skewness(u)).otherwise(0.0).alias("skew"), F.when(some, F.kurtosis(u)).otherwise(0.0).alias("kurtosis"))


def checked(p: DataFrame) -> DataFrame:
    """The pairs; a distance that is negative, NaN, infinite or missing is an error when they are read."""
    ok = F.col("d_hi").isNotNull() & ~F.isnan("d_hi") & (F.col("d_hi") >= 0) & (F.col("d_hi") < float("inf"))
    return p.withColumn("d_hi", F.when(ok, F.col("d_hi")).otherwise(F.raise_error(F.lit("a distance is negative, infinite or missing")).cast("double")))


def faults(p: DataFrame) -> DataFrame:
    """``fault, n``: how many distances ``checked`` would stop at, by what is wrong with them; a kind without any has no row."""
    d = F.col("d_hi")
    kind = F.when(d.isNull(), "missing").when(F.isnan(d), "not a number").when(d < 0, "negative").when(d == float("inf"), "infinite")
    return p.groupBy(kind.alias("fault")).agg(F.count(F.lit(1)).alias("n")).filter("fault IS NOT NULL")


def per_point_error(p: DataFrame) -> DataFrame:
    """Root mean squared residual over a point's partners, and its share of the squared input distances."""
    gap = (F.col("d_hi") - F.col("d_lo")) ** 2
    return both_ways(p).groupBy("i").agg(F.sqrt(F.avg(gap)).alias("rms"), ratio(F.sum(gap), F.sum(F.col("d_hi") ** 2)).alias("residual"))


def intrusion(r: DataFrame, k: int) -> DataFrame:
    """How far the true k nearest are in the map: median rank, median and 90 % quantile of distance over local spacing."""
    spacing = r.filter("q = 1").select("i", F.col("d_lo").alias("s"))
    near = r.filter(F.col("r") <= k).join(spacing, "i")
    far = ratio(F.col("d_lo"), F.col("s"))
    return near.agg(F.median("q").alias("median_rank"), F.median(far).alias("median_ratio"), F.percentile(far, 0.9).alias("p90_ratio"))


def rank_weights(r: DataFrame, beta: float) -> DataFrame:
    """Weights from mean neighbour ranks of the two directions, which meet by their unordered pair."""
    mean = r.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg((F.sum("r") / 2.0).alias("m"))
    return mean.select(F.col("a").alias("i"), F.col("b").alias("j"), F.pow(F.greatest(F.lit(1.0), F.col("m")), F.lit(-beta)).alias("w"))


def procrustes(points: DataFrame, a: str = "y", b: str = "z") -> DataFrame:
    """Disparity of two planar maps after translation, scaling and rotation or reflection: 1 - (sum of singular values)^2."""
    x = [F.col(a)[0], F.col(a)[1], F.col(b)[0], F.col(b)[1]]
    c = points.select(*[v.alias(n) for v, n in zip(x, "pqrs")])
    cov = lambda u, v: F.covar_pop(u, v)
    m = c.agg(cov("p", "r").alias("a"), cov("p", "s").alias("b"), cov("q", "r").alias("c"), cov("q", "s").alias("d"), (F.var_pop("p") + F.var_pop("q")).alias("u"), (F.var_pop("r") + F.var_pop("s")).alias("v"))
    frobenius = F.col("a") ** 2 + F.col("b") ** 2 + F.col("c") ** 2 + F.col("d") ** 2
    nuclear_squared = frobenius + 2 * F.abs(F.col("a") * F.col("d") - F.col("b") * F.col("c"))
    return m.select((1 - ratio(nuclear_squared, F.col("u") * F.col("v"))).alias("disparity"))


def evaluate(points: DataFrame, k: int = 7, ks: tuple[int, ...] = (7, 20)) -> DataFrame:
    """One wide row with every metric of a map.

    Where the points can go along with the tasks, one pass over slices of rows gives all that ranks and sums give;
    beyond that the window forms do. Both give the same values.
    """
    ks = tuple(dict.fromkeys((k, *ks)))
    if fits_broadcast(points):
        from .measures import Measured

        m = Measured(points, ks)
        prof, g = m.profile, m.classes
        wide, curve = profile_metrics(prof, ks, k), profile_curve(prof)
        more = profile_metrics(prof, ks, ks[-1]).select("trustworthiness", "continuity")
        correlated = m.shepard(points)
    else:
        p = pairs(points)
        g, correlated = Classes(p), shepard(p)
        r = ranks(p)
        curve = qnx_curve(r)
        wide = stress(p).drop("n_pairs").crossJoin(trust_continuity(r, k)).crossJoin(overlap(r, k)).crossJoin(neighborhood_hit(r, k)).crossJoin(distance_correlation(p)).crossJoin(silhouette(p)).crossJoin(auc_rnx(curve))
        more = trust_continuity(r, ks[-1]).select("trustworthiness", "continuity")
    more = more.withColumnsRenamed({"trustworthiness": "trustworthiness_far", "continuity": "continuity_far"})
    at = curve.filter(F.col("k").isin(*ks)).agg(*[F.max(F.when(F.col("k") == x, F.col(c))).alias(f"{c}_k{x}") for x in ks for c in ("qnx", "rnx")], F.max(F.when(F.col("k") == k, F.col("qnx") - F.col("k") / (F.col("n") - 1))).alias("lcmc_k"))
    share = local_global(curve).select("k_star", "q_local", "q_global")
    labelled = points.filter(F.col("label").isNotNull())
    several = labelled.agg(F.count_distinct("label").alias("c"), F.count(F.lit(1)).alias("m")).select(F.when((F.col("c") >= 2) & (F.col("c") < F.col("m")), F.lit(1.0)).alias("_known"))
    classes = davies_bouldin(labelled).crossJoin(distance_consistency(labelled)).crossJoin(several).select(*[(F.col(c) * F.col("_known")).alias(c) for c in ("davies_bouldin", "distance_consistency")])
    parts = [more, at, share, correlated, classes, centroid_spearman(g).toDF("centroid_dist_spearman"), spread_spearman(g).toDF("class_spread_spearman"), lie_factor(g).toDF("class_spread_lie_factor"), class_neighbours_kept(g).toDF("centroid_knn_preservation")]
    for part in parts:
        wide = wide.crossJoin(F.broadcast(part))
    return wide


#: Points whose coordinates take more than this many bytes aren't broadcast; the window forms above do it by shuffling.
BROADCAST_BYTES = 128 << 20


def fits_broadcast(points: DataFrame) -> bool:
    """Whether the coordinates of all points are proven small enough to go along with every task."""
    s = points.agg(F.count(F.lit(1)), F.max(F.size("x") + F.size("y"))).first()
    return (s[0] or 0) * ((s[1] or 0) + 2) * 8 <= BROADCAST_BYTES


def _shared(points: DataFrame):
    """Ids, coordinates and codes of the labels (-1 without one), by id."""
    t = points.select("id", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"), "label").toArrow().combine_chunks()
    ids = t.column("id").to_numpy().astype(np.int64)
    order = np.argsort(ids, kind="stable")
    names = t.column("label").to_pylist()
    codes = {c: k for k, c in enumerate(sorted(set(names) - {None}))}
    label = np.array([codes.get(v, -1) for v in names], np.int64)[order]
    x, y = (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column(n).chunks]).reshape(len(ids), -1)[order] for n in "xy") if len(ids) else (np.zeros((0, 1)),) * 2
    ids = ids[order]
    return points.sparkSession.sparkContext.broadcast((ids, x, y, label))


def _row_distances(a: np.ndarray, b: np.ndarray, high: int = 128, wide: int = 256) -> np.ndarray:
    """Distances of each row of ``a`` to all of ``b``, dimension by dimension (exact for near duplicates), in tiles that
    stay in a core's cache."""
    out = np.empty((len(a), len(b)))
    one, other = np.ascontiguousarray(a.T)[:, :, None], np.ascontiguousarray(b.T)[:, None, :]
    gap, total = np.empty((high, wide)), np.empty((high, wide))
    for r in range(0, len(a), high):
        for c in range(0, len(b), wide):
            n, m = min(high, len(a) - r), min(wide, len(b) - c)
            step, held = gap[:n, :m], total[:n, :m]
            held[:] = 0.0
            for k in range(a.shape[1]):
                np.subtract(one[k, r : r + n], other[k, :, c : c + m], out=step)
                np.multiply(step, step, out=step)
                np.add(held, step, out=held)
            np.sqrt(held, out=out[r : r + n, c : c + m])
    return out


def _row_ranks(d: np.ndarray) -> np.ndarray:
    """Ranks from 1 within each row, ties by place: rows with ties are sorted again in a stable way."""
    m, n = d.shape
    order = np.argsort(d, axis=1)
    value = np.take_along_axis(d, order, axis=1)
    tied = np.flatnonzero((value[:, 1:] == value[:, :-1]).any(1))
    if len(tied):
        order[tied] = np.argsort(d[tied], axis=1, kind="stable")
    ranks = np.empty((m, n), np.int32)
    np.put_along_axis(ranks, order, np.arange(1, n + 1, dtype=np.int32)[None, :], axis=1)
    return ranks


def _by_rows(points: DataFrame, work, schema: str, total=None, shared=None) -> DataFrame:
    """Applies ``work(rows, ids, x, y, label)`` to slices of row numbers; a slice's rows x points matrix stays near 32 MB.

    With ``total`` what the slices of a task give is added up by it, and a task gives one batch.
    """
    shared = shared or _shared(points)
    n = len(shared.value[0])
    spark = points.sparkSession
    step = max(1, min(512, (4 << 20) // max(n, 1)))
    slices = -(-n // step)

    def run(batches):
        found = (part for b in batches for k in b.column(0).to_pylist() for part in work(np.arange(k * step, min(n, k * step + step)), *shared.value))
        yield from found if total is None else total(found)

    return spark.range(0, slices, 1, max(1, min(slices, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)


def nearest(points: DataFrame, k: int, own: bool = False) -> DataFrame:
    """``i, j, rank, d_hi`` of the k nearest in the input, ties by id, without sorting all pairs. With ``own`` a point's label is the
    number it asks for, at most ``k``."""
    if not fits_broadcast(points):
        near = nearest_by_blocks(points, k)
        return near.join(points.select(F.col("id").alias("i"), F.col("label").alias("_own")), "i").filter("rank <= _own").drop("_own") if own else near
    asked = np.array(sorted(r[0] for r in points.select("label").distinct().collect())) if own else None

    def work(rows, ids, x, y, label):
        take = np.minimum(asked[label[rows]] if own else k, np.full(len(rows), len(ids) - 1))
        m = int(take.max(initial=0))
        if m < 1:
            return
        d = _row_distances(x[rows], x)
        d[np.arange(len(rows)), rows] = np.inf
        edge = np.partition(d, m - 1, axis=1)[:, m - 1]
        near = [np.flatnonzero(r <= e) for r, e in zip(d, edge)]  # ties at the edge stay until ids decide
        near = [c[np.lexsort((c, r[c]))][:t] for c, r, t in zip(near, d, take)]
        j = np.concatenate(near)
        i = np.repeat(np.arange(len(rows)), take)
        rank = np.concatenate([np.arange(1, t + 1, dtype=np.int32) for t in take])
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows][i]), pa.array(ids[j]), pa.array(rank), pa.array(d[i, j])], names=["i", "j", "rank", "d_hi"])

    return _by_rows(points, work, "i long, j long, rank int, d_hi double")


def nearest_by_blocks(points: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``nearest`` for coordinates too large to go along with tasks: each pair of blocks gives the k nearest of each point
    within it, and only these are brought together by point. A pair of blocks meets once, for both."""

    def work(tile):
        for way in (1,) if tile.same else (1, -1):
            for found in tiles.closest(*tile.ids[::way], *tile.x[0][::way], k):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=["i", "j", "d_hi"])

    some = tiles.over(points.withColumn("label", F.lit(None)), work, "i long, j long, d_hi double", ("x",), block, most=tiles.FEW)
    w = Window.partitionBy("i").orderBy("d_hi", "j")
    return some.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("i", "j", "rank", "d_hi")


PROFILE = "n long, classes long, labelled long, late_q array<double>, late_r array<double>, jaccard array<double>, common array<double>, hit array<double>, hits array<long>, sums array<double>, silhouette double, kept array<long>"


def profile(points: DataFrame, ks: tuple[int, ...] = (7, 20), more=None, extras: tuple[str, ...] = ()) -> DataFrame:
    """Partial sums of every map metric, one row per task, in a single pass over the distances.

    ``more(rows, ids, x, y, label, distances)`` gives further arrays, by the names ``extras``, which are added up too and come as bytes.

    ``kept`` counts pairs by the larger of their two ranks; ``sums`` are over ordered pairs and rows: Dd, d^2, D^2,
    (D-d)^2 / D, (D-d)^2, D, then row sums' D, d, Dd, D^2, d^2.
    """

    def work(rows, ids, x, y, label):
        n, m, at = len(ids), len(rows), np.arange(len(rows))
        hi, lo = _row_distances(x[rows], x), _row_distances(y[rows], y)
        also = more(rows, ids, x, y, label, (hi, lo)) if more else {}
        gap = (hi - lo) ** 2
        a, b = hi.sum(1), lo.sum(1)
        sums = [(hi * lo).sum(), (lo * lo).sum(), (hi * hi).sum(), (gap / np.maximum(hi, 1e-9)).sum(), gap.sum(), a.sum(), a.sum(), b.sum(), (a * b).sum(), (a * a).sum(), (b * b).sum()]
        sil = 0.0
        classes = np.arange(int(label.max(initial=-1)) + 1)
        mine = label[rows] >= 0
        if len(classes) > 1:
            size = np.array([(label == c).sum() for c in classes])
            total = np.stack([lo[:, label == c].sum(1) for c in classes], 1)
            own = np.maximum(label[rows], 0)
            alone = (size[own] < 2) | ~mine
            inner = total[at, own] / np.maximum(size[own] - 1, 1)
            mean = total / size
            mean[at, own] = np.inf
            outer = mean.min(1)
            top = np.maximum(inner, outer)
            sil = float(np.where(alone | (top == 0), 0.0, (outer - inner) / np.where(top == 0, 1, top)).sum())
        rank = []
        for d in (hi, lo):
            d[at, rows] = np.inf
            rank.append(_row_ranks(d))
        r, q = rank
        kept = np.bincount(np.maximum(r, q)[np.arange(n)[None, :] != rows[:, None]], minlength=n + 1)[1:n]
        out: dict[str, list] = {name: [] for name in ("late_q", "late_r", "jaccard", "common", "hit", "hits")}
        for k in ks:
            near, true = q <= k, r <= k
            out["late_q"].append(float(np.maximum(r[near] - k, 0).sum()))
            out["late_r"].append(float(np.maximum(q[true] - k, 0).sum()))
            c = (near & true).sum(1)
            out["jaccard"].append(float((c / (2.0 * k - c)).sum()))
            out["common"].append(float(c.sum()))
            known = near & mine[:, None] & (label >= 0)[None, :]
            out["hit"].append(float((known & (label[rows][:, None] == label[None, :])).sum()))
            out["hits"].append(int(known.sum()))
        yield {"n": n, "classes": len(classes), "labelled": int(mine.sum()), **{f: np.array(v) for f, v in out.items()}, "sums": np.array([float(v) for v in sums]), "silhouette": sil, "kept": kept, **also}

    def add_up(found):
        row: dict = {}
        for part in found:
            row = {f: v if f in ("n", "classes") or f not in row else row[f] + v for f, v in part.items()}
        if not row:
            return
        kinds = {"n": pa.int64(), "classes": pa.int64(), "labelled": pa.int64(), **{f: pa.list_(pa.float64()) for f in ("late_q", "late_r", "jaccard", "common", "hit")}, "hits": pa.list_(pa.int64()), "sums": pa.list_(pa.float64()), "silhouette": pa.float64(), "kept": pa.list_(pa.int64())}
        extra = [f for f in row if f not in kinds]
        yield pa.RecordBatch.from_arrays([pa.array([row[f]], t) for f, t in kinds.items()] + [pa.array([row[f].tobytes()], pa.binary()) for f in extra], names=[*kinds, *extra])

    return _by_rows(points, work, PROFILE + "".join(f", {f} binary" for f in extras), add_up)


def profile_curve(prof: DataFrame) -> DataFrame:
    """``n, k, qnx, rnx`` as ``qnx_curve`` gives it, from the counts of a profile."""
    hist = prof.select("n", F.posexplode("kept").alias("p", "c")).groupBy("n", (F.col("p") + 1).alias("k")).agg(F.sum("c").alias("c"))
    curve = hist.select("n", "k", (F.sum("c").over(Window.orderBy("k")) / (F.col("k") * F.col("n")).cast("double")).alias("qnx"))
    return curve.withColumn("rnx", ratio((F.col("n") - 1) * F.col("qnx") - F.col("k"), (F.col("n") - 1 - F.col("k")).cast("double")))


def profile_metrics(prof: DataFrame, ks: tuple[int, ...] = (7, 20), k: int = 7) -> DataFrame:
    """One wide row: stresses, scale, trust and continuity, overlaps, hit, distance correlation, silhouette, AUC."""
    at = ks.index(k)
    part = lambda c: F.sum(F.col(c)[at])
    s = [F.sum(F.col("sums")[i]) for i in range(11)]
    n = F.max("n").cast("double")
    w = prof.agg(n.alias("n"), *[x.alias(f"s{i}") for i, x in enumerate(s)], part("late_q").alias("lq"), part("late_r").alias("lr"), part("jaccard").alias("ja"), part("common").alias("co"), part("hit").alias("hi"), part("hits").alias("hn"), F.sum("silhouette").alias("si"), F.max("classes").alias("cl"), F.sum("labelled").alias("la"))
    c = {x: F.col(x) for x in w.columns}
    norm = c["n"] * k * (2 * c["n"] - 3 * k - 1)
    keep = lambda late: F.when(2 * c["n"] - 3 * k - 1 > 0, 1 - ratio(2.0 * late, norm))
    cov = lambda t, r, a, b: t / c["n"] ** 2 - 2 * r / c["n"] ** 3 + a * b / c["n"] ** 4
    square = ratio(cov(c["s0"], c["s8"], c["s6"], c["s7"]), F.sqrt(cov(c["s2"], c["s9"], c["s6"], c["s6"]) * cov(c["s1"], c["s10"], c["s7"], c["s7"])))
    row = w.select(
        (1 - ratio(c["s0"] ** 2, c["s2"] * c["s1"])).alias("scale_invariant"), ratio(c["s0"], c["s1"]).alias("scale"), ratio(c["s3"], c["s5"]).alias("relative"), F.sqrt(ratio(c["s4"], c["s1"])).alias("kruskal"),
        F.lit(k).alias("k"), keep(c["lq"]).alias("trustworthiness"), keep(c["lr"]).alias("continuity"), (c["ja"] / c["n"]).alias("jaccard"), (c["co"] / c["n"]).alias("common"),
        ratio(c["hi"], c["hn"].cast("double")).alias("hit"), F.sqrt(F.greatest(square, F.lit(0.0))).alias("dcor"), F.when((c["cl"] >= 2) & (c["cl"] < c["la"]), c["si"] / c["la"]).alias("silhouette"),
    )
    return row.crossJoin(auc_rnx(profile_curve(prof)))


def exact_median(df: DataFrame, column: str, bands: int = 4096, most: int = 100_000) -> DataFrame:
    """The median of a large column, one row.

    Each pass counts the values in bands of equal width between two ends and goes on with the bands that hold the
    middle, until at most ``most`` values are left, which are looked at one by one. Only counts are ever shuffled.
    """
    v = F.col(column)
    ends = df.agg(F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("m")).first()
    low, high, below, inside = ends["low"], ends["high"], 0, ends["m"]
    places = [(inside - 1) // 2, inside // 2]  # from 0, over all values
    while inside > most and low < high:
        width = (high - low) / bands
        band = F.least(F.lit(bands - 1), F.floor((v - F.lit(low)) / F.lit(width))).cast("int")
        rows = df.filter(v.between(low, high)).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("c"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect()
        rows.sort(key=lambda r: r["band"])
        upto, met = below, []
        for r in rows:
            if upto <= places[1] and upto + r["c"] > places[0]:
                met.append((upto, r))
            upto += r["c"]
        new = (met[0][1]["lo"], met[-1][1]["hi"], met[0][0], sum(r["c"] for _, r in met))
        if new[3] == inside:
            break
        low, high, below, inside = new
    if not inside:
        middle = None
    elif low == high:
        middle = low
    else:
        left = [r[0] for r in df.filter(v.between(low, high)).groupBy(column).agg(F.count(F.lit(1)).alias("c")).orderBy(column).select(F.col(column), "c").collect() for _ in range(r[1])] if inside <= most else None
        if left is None:  # the values can't be told apart by bands: order them, wherever they are
            order = df.filter(v.between(low, high)).select(v.alias("v")).withColumn("p", F.row_number().over(Window.orderBy("v")) - 1 + below)
            return order.filter(F.col("p").isin(places)).agg(F.avg("v").alias("median"))
        middle = (left[places[0] - below] + left[places[1] - below]) / 2
    return df.sparkSession.createDataFrame([(middle,)], "median double")
