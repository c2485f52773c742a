"""Queries on tables of runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import poisson
from ..operators import results as res
from ..operators.lineage import scratch
from ..sources import keyed, sinks
from ..operators import resampling as rs
from .registry import query
from .tables import MEDIANS, RUNS, runs, table

W = "WITH "
A, B = "1-URGENT", "5-LOW"


def below(x: str) -> str:
    """DuckDB's form of the normal distribution function: Simpson's rule from 0 to ``x``."""
    return f"(0.5 + ({x}) / 2000.0 / 3 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * (({x}) * i / 2000.0)**2))) / sqrt(2 * pi()))"


def wide(s, d):
    return res.medians(runs(s, d), "v")


def diffs(s, d):
    return res.paired(wide(s, d), A, B)


PAIRED = MEDIANS + f""", paired AS (SELECT dataset, max(v) FILTER ("method" = '{A}') va, max(v) FILTER ("method" = '{B}') vb FROM wide GROUP BY dataset HAVING va IS NOT NULL AND vb IS NOT NULL), diffs AS (SELECT dataset, va, vb, va - vb diff FROM paired)"""
COMPLETE = MEDIANS + """, complete AS (SELECT * FROM wide QUALIFY count(*) OVER (PARTITION BY dataset) = (SELECT count(DISTINCT "method") FROM wide)), ranked AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY v) + (count(*) OVER (PARTITION BY dataset, v) - 1) / 2.0 rk FROM complete)"""


@query("flt01_ok_rows", W + RUNS + " SELECT run, dataset, round(v, 6) v FROM runs WHERE status = 'ok' AND v IS NOT NULL")
def _(s, d):
    return res.ok(runs(s, d), "v").select("run", "dataset", "v")


@query("agg01_median_iqr", W + RUNS + """ SELECT dataset, "method", round(median(v), 4) median, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 4) iqr, count(*) n FROM runs WHERE status = 'ok' GROUP BY ALL""", 4)
def _(s, d):
    return res.median_iqr(runs(s, d), "v", "dataset", "method")


@query("agg02_two_level_median", W + MEDIANS + ' SELECT "method", round(median(v), 4) median, count(*) n_datasets FROM wide GROUP BY ALL', 4)
def _(s, d):
    return res.two_level_median(runs(s, d), "v")


@query("agg04_distinct_counts", W + RUNS + ' SELECT count(DISTINCT dataset) datasets, count(DISTINCT "method") methods, count(DISTINCT seed) seeds FROM runs')
def _(s, d):
    return runs(s, d).agg(F.count_distinct("dataset").alias("datasets"), F.count_distinct("method").alias("methods"), F.count_distinct("seed").alias("seeds"))


@query("agg05_flags", W + RUNS + " SELECT dataset, bool_or(status = 'error') any_error, bool_and(v > 1000) all_large FROM runs GROUP BY ALL")
def _(s, d):
    return runs(s, d).groupBy("dataset").agg(F.bool_or(F.col("status") == "error").alias("any_error"), F.bool_and(F.col("v") > 1000).alias("all_large"))


@query("agg06_best", W + MEDIANS + ' SELECT dataset, "method", round(v, 4) v FROM wide QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY v DESC, "method") = 1', 4)
def _(s, d):
    return res.best_per_dataset(wide(s, d))


@query("agg07_constrained_best", W + MEDIANS + f""", b AS (SELECT dataset, v base FROM costs WHERE "method" = '{B}'), a AS (SELECT c.dataset, c."method" FROM costs c JOIN b USING (dataset) WHERE c.v <= 1.05 * base)
SELECT w.dataset, w."method", round(w.v, 4) v FROM wide w JOIN a ON a.dataset = w.dataset AND a."method" = w."method" QUALIFY row_number() OVER (PARTITION BY w.dataset ORDER BY w.v DESC, w."method") = 1""", 4)
def _(s, d):
    return res.constrained_best(wide(s, d), res.medians(runs(s, d), "cost"), B, 1.05)


@query("agg08_wins", W + PAIRED + " SELECT count(*) FILTER (diff > 0) wins_a, count(*) FILTER (diff < 0) wins_b, count(*) FILTER (diff = 0) ties FROM diffs")
def _(s, d):
    return res.wins(diffs(s, d))


@query("agg10_mcnemar", W + PAIRED + ", f AS (SELECT va > 150000 a, vb > 150000 b FROM diffs) SELECT count(*) FILTER (a AND b) n11, count(*) FILTER (a AND NOT b) n10, count(*) FILTER (NOT a AND b) n01, count(*) FILTER (NOT a AND NOT b) n00 FROM f")
def _(s, d):
    return res.mcnemar(diffs(s, d).select((F.col("va") > 150000).alias("a"), (F.col("vb") > 150000).alias("b")), "a", "b").select("n11", "n10", "n01", "n00")


@query("agg11_majority", W + RUNS + """, g AS (SELECT dataset, "method", median((v > 150000)::INT) > 0.5 correct FROM runs WHERE status = 'ok' GROUP BY ALL) SELECT "method", round(avg((NOT correct)::INT), 6) error_rate FROM g GROUP BY ALL""")
def _(s, d):
    g = res.ok(runs(s, d), "v").groupBy("dataset", "method").agg((F.median((F.col("v") > 150000).cast("int")) > 0.5).alias("correct"))
    return g.groupBy("method").agg(F.avg((~F.col("correct")).cast("double")).alias("error_rate"))


@query("agg19_pooled_and_by_level", W + RUNS + """ SELECT "method", round(avg((v > 200000)::INT), 6) fraction, count(*) n FROM runs WHERE status = 'ok' GROUP BY GROUPING SETS ((), ("method"))""")
def _(s, d):
    return res.ok(runs(s, d), "v").rollup("method").agg(F.avg((F.col("v") > 200000).cast("double")).alias("fraction"), F.count(F.lit(1)).alias("n"))


@query("agg20_main_effects", W + RUNS + """ SELECT dataset, "method", status, seed, round(median(v), 4) v FROM runs GROUP BY GROUPING SETS ((dataset, "method"), (dataset, status), (dataset, seed))""", 4)
def _(s, d):
    sets = [[F.col(c) for c in ("dataset", f)] for f in ("method", "status", "seed")]
    return runs(s, d).groupingSets(sets, "dataset", "method", "status", "seed").agg(F.median("v").alias("v"))


@query("agg29_cube", W + RUNS + ' SELECT region::BIGINT AS region, "method", status, count(*) n FROM runs GROUP BY CUBE (region, "method", status)')
def _(s, d):
    return runs(s, d).cube("region", "method", "status").agg(F.count(F.lit(1)).alias("n"))


@query("agg23_regression", W + RUNS + " SELECT dataset, round(regr_slope(v, cost), 6) slope, round(regr_intercept(v, cost), 2) AS intercept FROM runs GROUP BY ALL", 6)
def _(s, d):
    return runs(s, d).groupBy("dataset").agg(F.regr_slope("v", "cost").alias("slope"), F.round(F.regr_intercept("v", "cost"), 2).alias("intercept"))


@query("agg26_collect", W + MEDIANS + """ SELECT dataset, string_agg("method", ';' ORDER BY "method") methods FROM wide GROUP BY ALL""")
def _(s, d):
    return wide(s, d).groupBy("dataset").agg(F.array_join(F.sort_array(F.collect_list("method")), ";").alias("methods"))


@query("win03_average_rank", W + COMPLETE + ' SELECT "method", round(avg(rk), 6) avg_rank, count(*) n FROM ranked GROUP BY ALL')
def _(s, d):
    return res.average_ranks(wide(s, d))


@query("st01_friedman", W + COMPLETE + """, s AS (SELECT "method", sum(rk) s, count(*) n FROM ranked GROUP BY ALL), g AS (SELECT sum(s * s) s2, max(n)::DOUBLE n, count(*)::DOUBLE k FROM s), t AS (SELECT sum(c * c * c - c)::DOUBLE t FROM (SELECT count(*) c FROM ranked GROUP BY dataset, v))
SELECT n::BIGINT n, k::BIGINT k, round((12 / (n*k*(k+1)) * s2 - 3*n*(k+1)) / (1 - t / (n * (k**3 - k))), 6) chi2, round((12 / (n*k*(k+1)) * s2 - 3*n*(k+1)) / (1 - t / (n * (k**3 - k))) / (n * (k - 1)), 6) kendall_w FROM g, t""")
def _(s, d):
    return res.friedman(wide(s, d)).drop("p")


FRIEDMAN = COMPLETE + """, s AS (SELECT "method", sum(rk) s, count(*) n FROM ranked GROUP BY ALL), g AS (SELECT sum(s * s) s2, max(n)::DOUBLE n, count(*)::DOUBLE k FROM s), t AS (SELECT sum(c * c * c - c)::DOUBLE t FROM (SELECT count(*) c FROM ranked GROUP BY dataset, v))
, fr AS (SELECT n::BIGINT n, k::BIGINT k, (12 / (n*k*(k+1)) * s2 - 3*n*(k+1)) / (1 - t / (n * (k**3 - k))) chi2 FROM g, t), frp AS (SELECT *, chi2 / (n * (k - 1)) kendall_w, 1 - chi2 / 4000.0 / 3 * list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * (chi2 * i / 4000.0)**((k - 1) / 2.0 - 1) * exp(-chi2 * i / 8000.0))) / (2**((k - 1) / 2.0) * gamma((k - 1) / 2.0)) p FROM fr)"""


@query("st01_friedman_p", W + FRIEDMAN + " SELECT n, k, round(chi2, 6) chi2, round(kendall_w, 6) kendall_w, round(p, 6) p FROM frp")
def _(s, d):
    return res.friedman(wide(s, d))


#: Upper 5 % point of the range of five standard normal variables. Fixed value, as tables print it.
RANGE_5_OF_5 = 3.857656


@query("st02_critical_difference", W + COMPLETE + f', a AS (SELECT "method", count(*) n FROM ranked GROUP BY ALL) SELECT count(*) k, max(n) n, round({RANGE_5_OF_5} / sqrt(2) * sqrt(count(*) * (count(*) + 1) / (6.0 * max(n))), 5) cd FROM a', 5)
def _(s, d):
    return res.critical_difference(res.average_ranks(wide(s, d)))


@query("st04_experiment", W + FRIEDMAN + f""" SELECT "method", round(avg(rk), 5) avg_rank, n n_datasets, k n_methods, round(chi2, 5) chi2, round(kendall_w, 5) kendall_w, round(p, 5) p, round({RANGE_5_OF_5} / sqrt(2) * sqrt(k * (k + 1) / (6.0 * n)), 5) cd FROM ranked, frp GROUP BY "method", n, k, chi2, kendall_w, p""", 5)
def _(s, d):
    return res.experiment_statistics(runs(s, d), "v")


@query("st03_cliques", W + COMPLETE + """, a AS (SELECT "method", avg(rk) r FROM ranked GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY r, "method") p FROM a)
, e AS (SELECT x.p, x."method" f, max(y.p) z FROM o x JOIN o y ON y.p >= x.p AND y.r - x.r < 0.5 GROUP BY ALL), k AS (SELECT *, max(z) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) b FROM e)
SELECT f "first", o."method" "last", z - k.p + 1 size FROM k JOIN o ON o.p = z WHERE z > k.p AND (b IS NULL OR z > b)""")
def _(s, d):
    return res.cliques(res.average_ranks(wide(s, d)), 0.5)


SIGNED = PAIRED + """, rk AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2.0 rk FROM diffs WHERE diff <> 0), ti AS (SELECT coalesce(sum(c*c*c - c), 0)::DOUBLE t FROM (SELECT count(*) c FROM rk GROUP BY rk))
, g AS (SELECT (SELECT count(*) FROM diffs) n, count(*) m, coalesce(sum(rk) FILTER (diff > 0), 0)::DOUBLE w FROM rk), z AS (SELECT n, m n_nonzero, w w_plus, CASE WHEN n >= 5 AND m > 0 THEN (w - m*(m+1)/4.0) / sqrt(m*(m+1)*(2*m+1)/24.0 - t/48) END z, n >= 5 AND m > 0 AND n <= 50 AND m = n AND t = 0 AS exact FROM g, ti)"""


@query("st05_wilcoxon", W + SIGNED + " SELECT n, n_nonzero, round(w_plus, 6) w_plus, round(z, 6) z, exact FROM z")
def _(s, d):
    return res.wilcoxon(diffs(s, d)).drop("p")


@query("st05_wilcoxon_p", "WITH RECURSIVE " + SIGNED + f""", dp(k, c) AS (SELECT 0, list_transform(range(0, 1276), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0 END) UNION ALL SELECT k + 1, list_transform(range(0, 1276), lambda i: c[i + 1] + CASE WHEN i > k THEN c[i - k] ELSE 0 END) FROM dp WHERE k < (SELECT n FROM z WHERE n <= 50))
SELECT n, n_nonzero, round(w_plus, 6) w_plus, round(z, 6) z, exact, round(CASE WHEN exact THEN least(1, 2 * least(list_sum(c[1:w_plus::BIGINT + 1]), list_sum(c[w_plus::BIGINT + 1:])) / 2.0**n) ELSE 2 * (1 - {below('abs(z)')}) END, 6) p FROM z, dp WHERE k = (SELECT max(k) FROM dp)""")
def _(s, d):
    return res.wilcoxon(diffs(s, d))


FLIPS = PAIRED + """, o AS (SELECT abs(diff) diff, row_number() OVER (ORDER BY dataset) - 1 k FROM diffs WHERE diff <> 0), g AS (SELECT count(*) n FROM o), tt AS (SELECT sum(diff) t FROM diffs), a AS (SELECT m, sum(CASE WHEN (m >> k) & 1 = 1 THEN -diff ELSE diff END) v FROM (SELECT unnest(range(0, 4096)) m), o WHERE k < 12 GROUP BY m)
, b AS (SELECT m, sum(CASE WHEN (m >> (k - 12)) & 1 = 1 THEN -diff ELSE diff END) v FROM (SELECT unnest(range(0, (SELECT 1::BIGINT << greatest(n - 12, 0) FROM g))) m), o WHERE k >= 12 GROUP BY m), s AS (SELECT a.v + b.v v FROM a, b)"""


@query("st06_sign_flip", W + FLIPS + " SELECT n, round((SELECT count(*) FROM s, tt WHERE v >= t - 1e-6) / (1::BIGINT << n)::DOUBLE, 6) p, true AS exact FROM g")
def _(s, d):
    return res.sign_flip(diffs(s, d), most=30)


@query("st06_sign_flip_less", W + FLIPS + " SELECT n, round((SELECT count(*) FROM s, tt WHERE v <= t + 1e-6) / (1::BIGINT << n)::DOUBLE, 6) p, true AS exact FROM g")
def _(s, d):
    return res.sign_flip(diffs(s, d), "less", most=30)


@query("st06_sign_flip_two_sided", W + FLIPS + " SELECT n, round(least(1, 2 * (SELECT count(*) FROM s, tt WHERE v >= abs(t) - 1e-6) / (1::BIGINT << n)::DOUBLE), 6) p, true AS exact FROM g")
def _(s, d):
    return res.sign_flip(diffs(s, d), "two-sided", most=30)


@query("st08_sign_flip_dispatch")
def _(s, d):
    return res.sign_flip(diffs(s, d), "greater", most=22, draws=10_000, seed=42)


@query("st10_bootstrap")
def _(s, d):
    return res.bootstrap_median(diffs(s, d), 500, 42)


@query("st10_bootstrap_mean")
def _(s, d):
    return rs.bootstrap_mean(diffs(s, d), "diff", "dataset", 500, 42)


@query("st10_bootstrap_spearman")
def _(s, d):
    return rs.bootstrap_spearman(diffs(s, d), "va", "vb", "dataset", 500, 42)


def _drawn(rows: str, statistic: str, terms: str, draws: int, seed: int) -> str:
    """Rows ``g, k`` and terms, crossed with all draws: what the one pass avoids."""
    h = "('0x' || md5(coalesce(k::VARCHAR, ''))[1:7])::BIGINT"
    weighed = ", ".join(f"sum(w * {t}) {t}" for t in terms.split())
    return f"""{rows}, h AS (SELECT *, {h} h FROM r), d AS (SELECT *, {poisson.weight_sql('h', 'd', seed)} w FROM h, range({draws}) t(d)), s AS (SELECT g, d, {weighed} FROM d WHERE w > 0 GROUP BY ALL), v AS (SELECT g, {statistic} s FROM s)
, a AS (SELECT g, {statistic} s FROM (SELECT g, {', '.join(f'sum({t}) {t}' for t in terms.split())} FROM r GROUP BY g)) SELECT a.g "group", round(any_value(a.s), 5) "value", round(quantile_cont(v.s, 0.025), 5) low, round(quantile_cont(v.s, 0.975), 5) high, count(v.s) draws FROM a JOIN v USING (g) GROUP BY a.g"""


@query("snk01_keyed_table", "WITH " + RUNS + ', r AS (SELECT dataset, "method", seed, min(run) run FROM runs GROUP BY ALL) SELECT dataset, "method", count(*) n, sum(run)::BIGINT run FROM r GROUP BY ALL')
def _(s, d):
    """Runs by data set, method and seed in three writes that overlap, one of them made twice: each key once, with its first run."""
    one = runs(s, d).groupBy("dataset", "method", "seed").agg(F.min("run").alias("run"))
    path = scratch(s)
    for name, part in (("low", "seed < 6"), ("high", "seed >= 4"), ("low", "seed < 6"), ("all", "true")):
        out = keyed.append(one.filter(part), path, ["dataset", "method", "seed"], name)
    return out.groupBy("dataset", "method").agg(F.count(F.lit(1)).alias("n"), F.sum("run").alias("run"))


@query("st10_poisson_mean", "WITH " + RUNS + ", " + _drawn("""r AS (SELECT "method" g, run k, 1.0::DOUBLE n, v::DOUBLE s FROM runs WHERE v IS NOT NULL)""", "s / n", "n s", 200, 42), 5)
def _(s, d):
    terms, mean = poisson.mean_of("v")
    return poisson.interval(runs(s, d), "run", terms, mean, 200, 42, group=F.col("method"))


@query("st10_poisson_slope", "WITH " + RUNS + ", " + _drawn("r AS (SELECT '' g, dataset k, 1.0::DOUBLE n, cost / 1000.0::DOUBLE sx, v / 1000.0::DOUBLE sy, sx * sx xx, sx * sy xy FROM runs WHERE v IS NOT NULL AND cost IS NOT NULL)", "(n * xy - sx * sy) / nullif(n * xx - sx * sx, 0)", "n sx sy xx xy", 200, 7), 5)
def _(s, d):
    """Clusters are resampled: all runs of a data set share its weight."""
    terms, slope = poisson.slope_of("a", "b")
    return poisson.interval(runs(s, d).withColumn("a", F.col("cost") / 1000.0).withColumn("b", F.col("v") / 1000.0), "dataset", terms, slope, 200, 7)


@query("st11_holm", W + RUNS + """, h AS (SELECT dataset, region, count(*) hash_ FROM runs GROUP BY ALL), t AS (SELECT dataset, region::BIGINT AS region, (hash_ * 37 % 997) / 9970.0 p FROM h), m AS (SELECT *, count(p) OVER (PARTITION BY region) m, row_number() OVER (PARTITION BY region ORDER BY p, dataset) r FROM t)
SELECT dataset, region, round(p, 6) p, round(max(least(1, (m - r + 1) * p)) OVER (PARTITION BY region ORDER BY p, dataset ROWS UNBOUNDED PRECEDING), 6) p_holm FROM m""")
def _(s, d):
    t = runs(s, d).groupBy("dataset", "region").agg((F.count(F.lit(1)) * 37 % 997 / 9970.0).alias("p"))
    return res.holm(t, "region", "p", "dataset")


@query("st12_hodges_lehmann", W + PAIRED + " SELECT round(median((a.diff + b.diff) / 2), 4) hodges_lehmann FROM diffs a JOIN diffs b ON a.dataset <= b.dataset", 4)
def _(s, d):
    return res.hodges_lehmann(diffs(s, d))


@query("st13_cliffs_delta", W + MEDIANS + f""" SELECT round(avg(sign(a.v - b.v)), 6) delta FROM wide a, wide b WHERE a."method" = '{A}' AND b."method" = '{B}'""")
def _(s, d):
    return res.cliffs_delta(wide(s, d), A, B)


@query("st13_paired_dominance", W + PAIRED + " SELECT round(avg(sign(diff)), 6) delta_pair FROM diffs")
def _(s, d):
    return res.paired_dominance(diffs(s, d))


def _t_upper(t: str) -> str:
    """DuckDB's form of the t distribution's upper tail at ``t`` with n - 1 degrees of freedom."""
    density = f"exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt((n - 1) * pi()) * (1 + (({t}) * i / 4000.0)**2 / (n - 1))**(-n / 2.0)"
    return f"(0.5 - ({t}) / 4000.0 / 3 * list_sum(list_transform(range(0, 4001), lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density})))"


@query("st14_tost", W + PAIRED + f", m AS (SELECT count(*) n, avg(diff) mean, stddev_samp(diff) sd FROM diffs) SELECT n, round(mean, 4) mean, round(sd, 4) sd, round(greatest({_t_upper('(mean + 20000) / (sd / sqrt(n))')}, {_t_upper('-(mean - 20000) / (sd / sqrt(n))')}), 4) p FROM m", 4)
def _(s, d):
    return res.tost(diffs(s, d), 20_000.0)


@query("st16_summary", W + PAIRED + """, m AS (SELECT median(diff) m FROM diffs) SELECT round(max(m), 4) median, round(avg(diff), 4) mean, round(stddev_samp(diff), 4) sd, round(median(abs(diff - m)), 4) mad, round(avg((diff > 0)::INT), 4) share_positive, round(1.4826 * median(abs(diff - m)), 4) robust_sigma FROM diffs, m""", 4)
def _(s, d):
    return res.summary(diffs(s, d))


@query("jn08_pending", W + RUNS + """, t AS (SELECT DISTINCT dataset, "method", seed FROM (SELECT DISTINCT dataset FROM runs), (SELECT DISTINCT "method" FROM runs), (SELECT DISTINCT seed FROM runs)), d AS (SELECT DISTINCT dataset, "method", seed FROM runs WHERE status = 'ok')
SELECT t.dataset, t."method", t.seed FROM t ANTI JOIN d ON t.dataset = d.dataset AND t."method" = d."method" AND t.seed = d.seed""")
def _(s, d):
    r = runs(s, d)
    grid = r.select("dataset").distinct().crossJoin(r.select("method").distinct()).crossJoin(r.select("seed").distinct())
    return res.pending(grid, r.filter("status = 'ok'"), ["dataset", "method", "seed"])


@query("jn07_semi", W + RUNS + " SELECT run FROM runs WHERE dataset IN (SELECT dataset FROM runs GROUP BY dataset HAVING median(v) > 140000)")
def _(s, d):
    r = runs(s, d)
    return r.join(r.groupBy("dataset").agg(F.median("v").alias("m")).filter("m > 140000"), "dataset", "left_semi").select("run")


@query("jn06_full_outer", W + MEDIANS + """ SELECT coalesce(a.dataset, b.dataset) dataset, round(a.v, 4) va, round(b.v, 4) vb FROM (SELECT * FROM wide WHERE "method" = '1-URGENT' AND v > 140000) a FULL JOIN (SELECT * FROM wide WHERE "method" = '5-LOW' AND v > 140000) b ON a.dataset = b.dataset""", 4)
def _(s, d):
    w = wide(s, d).filter("v > 140000")
    a, b = w.filter(F.col("method") == A).select("dataset", F.col("v").alias("va")), w.filter(F.col("method") == B).select("dataset", F.col("v").alias("vb"))
    return a.join(b, "dataset", "full_outer")


@query("jn11_relative_to_baseline", W + RUNS + """, g AS (SELECT dataset, nullif("method", '3-MEDIUM') alpha, seed % 5 lam, median(v) v FROM runs WHERE status = 'ok' AND NOT (dataset LIKE 'A%' AND seed % 5 = 0) GROUP BY ALL), b AS (SELECT *, max(v) FILTER (lam = 0) OVER (PARTITION BY dataset, alpha) base, count(*) FILTER (lam = 0) OVER (PARTITION BY dataset, alpha) c FROM g) SELECT dataset, alpha, lam, round(v / nullif(base, 0), 6) relative FROM b WHERE c > 0""")
def _(s, d):
    r = res.ok(runs(s, d), "v").filter(~(F.col("dataset").startswith("A") & (F.col("seed") % 5 == 0)))  # some groups have no baseline
    g = r.groupBy("dataset", F.nullif("method", F.lit("3-MEDIUM")).alias("alpha"), (F.col("seed") % 5).alias("lam")).agg(F.median("v").alias("v"))
    return res.relative_to_baseline(g, "v", "lam", ["dataset", "alpha"]).drop("v")


@query("jn12_nearest_value", W + RUNS + """, l AS (SELECT run, dataset, v FROM runs WHERE "method" = '1-URGENT'), r AS (SELECT run, dataset, v FROM runs WHERE "method" = '5-LOW')
SELECT l.run, l.dataset, round(l.v, 4) v, round(r.v, 4) nearest, r.run nearest_id FROM l JOIN r ON l.dataset = r.dataset QUALIFY row_number() OVER (PARTITION BY l.run ORDER BY abs(l.v - r.v), r.run) = 1""", 4)
def _(s, d):
    r = runs(s, d)
    left = r.filter(F.col("method") == A).select("run", "dataset", "v")
    return res.nearest_by_value(left, r.filter(F.col("method") == B).select(F.col("run").alias("rid"), "dataset", F.col("v").alias("w")), "dataset", "v", "w", "rid").filter("nearest is not null")


@query("jn13_interpolate", W + RUNS + """, g AS (SELECT dataset, seed x, median(v) y FROM runs GROUP BY ALL), a AS (SELECT dataset, (count(*) % 23) / 2.0 - 1 want FROM runs GROUP BY ALL), b AS (SELECT *, lead(x) OVER w x1, lead(y) OVER w y1, lag(x) OVER w IS NULL f FROM g WINDOW w AS (PARTITION BY dataset ORDER BY x))
SELECT dataset, want, round(CASE WHEN x1 IS NULL OR want < x THEN y ELSE y + (y1 - y) * (want - x) / (x1 - x) END, 4) "value" FROM a JOIN b USING (dataset) WHERE (x <= want AND (x1 IS NULL OR want < x1)) OR (f AND want < x)""", 4)
def _(s, d):
    r = runs(s, d)
    at = r.groupBy("dataset").agg((F.count(F.lit(1)) % 23 / 2.0 - 1).alias("want"))
    return res.interpolate(r.groupBy("dataset", F.col("seed").alias("x")).agg(F.median("v").alias("y")), at, "dataset", "x", "y", "want")


@query("st18_pareto", W + RUNS + """ SELECT dataset, run, round(v, 4) v, round(cost, 4) cost FROM runs a WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE b.dataset = a.dataset AND b.v >= a.v AND b.cost >= a.cost AND (b.v > a.v OR b.cost > a.cost))""", 4)
def _(s, d):
    return res.pareto_front(runs(s, d), "dataset", "run", "v", "cost")


@query("st18_front_counts", W + RUNS + """, f AS (SELECT dataset, run, "method" FROM runs a WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE b.dataset = a.dataset AND b.v >= a.v AND b.cost >= a.cost AND (b.v > a.v OR b.cost > a.cost))) SELECT "method", count(*) n, count(DISTINCT dataset) datasets FROM f GROUP BY ALL""")
def _(s, d):
    r = runs(s, d)
    return res.pareto_front(r, "dataset", "run", "v", "cost").join(r.select("run", "method"), "run").groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dataset").alias("datasets"))


@query("flt11_regimes", W + MEDIANS + """, g AS (SELECT dataset, min(v) / max(v) q FROM wide GROUP BY ALL) SELECT dataset, CASE WHEN ln(q) < -0.2 THEN 'low' WHEN ln(q) < -0.08 THEN 'middle' ELSE 'high' END regime FROM g""")
def _(s, d):
    return wide(s, d).groupBy("dataset").agg((F.min("v") / F.max("v")).alias("q")).select("dataset", res.regime(F.col("q"), -0.2, -0.08).alias("regime"))


@query("st19_regime_table", W + PAIRED + """, g AS (SELECT dataset, CASE WHEN ln(min(v) / max(v)) < -0.2 THEN 'low' WHEN ln(min(v) / max(v)) < -0.08 THEN 'middle' ELSE 'high' END regime FROM wide GROUP BY dataset)
SELECT regime, "method" AS row_, round(median(v), 4) median, count(*) n FROM wide JOIN g USING (dataset) GROUP BY ALL UNION ALL SELECT regime, 'paired', round(median(diff), 4), count(*) FROM diffs JOIN g USING (dataset) GROUP BY ALL""", 4)
def _(s, d):
    w = wide(s, d)
    g = w.groupBy("dataset").agg((F.min("v") / F.max("v")).alias("q")).select("dataset", res.regime(F.col("q"), -0.2, -0.08).alias("regime"))
    stat = lambda df, c, *by: df.join(g, "dataset").groupBy("regime", *by).agg(F.median(c).alias("median"), F.count(F.lit(1)).alias("n"))
    return stat(w, "v", F.col("method").alias("row_")).unionByName(stat(res.paired(w, A, B), "diff").withColumn("row_", F.lit("paired")))


@query("st24_pivot_threshold", W + MEDIANS + """, p AS (SELECT dataset, max(v) FILTER ("method" = '1-URGENT') a, max(v) FILTER ("method" = '2-HIGH') b, max(v) FILTER ("method" = '5-LOW') c FROM wide GROUP BY ALL) SELECT round(median(greatest((a - b) / a, (a - c) / a)), 6) tau, count(*) n FROM p""")
def _(s, d):
    p = wide(s, d).groupBy("dataset").pivot("method", [A, "2-HIGH", B]).agg(F.max("v"))
    fall = lambda c: (F.col(A) - F.col(c)) / F.col(A)
    return p.agg(F.median(F.greatest(fall("2-HIGH"), fall(B))).alias("tau"), F.count(F.lit(1)).alias("n"))


@query("st25_thresholds", W + PAIRED + """, t AS (SELECT unnest([0.0, 5000.0, 20000.0])::DOUBLE tau) SELECT tau, count(*) FILTER (abs(diff) > tau) kept, round(avg(diff) FILTER (abs(diff) > tau), 4) mean FROM t, diffs GROUP BY tau""", 4)
def _(s, d):
    t = s.createDataFrame([(0.0,), (5000.0,), (20000.0,)], "tau double")
    kept = F.abs("diff") > F.col("tau")
    return diffs(s, d).crossJoin(F.broadcast(t)).groupBy("tau").agg(F.count_if(kept).alias("kept"), F.avg(F.when(kept, F.col("diff"))).alias("mean"))


@query("st27_correlations", W + RUNS + """, l AS (UNPIVOT (SELECT run, v AS m1, cost AS m2, seed::DOUBLE AS m3 FROM runs) ON m1, m2, m3 INTO NAME metric VALUE x), j AS (SELECT p.metric a, q.metric b, p.x u, q.x w FROM l p JOIN l q ON p.run = q.run AND p.metric < q.metric)
, r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY u) + (count(*) OVER (PARTITION BY a, b, u) - 1) / 2.0 ra, rank() OVER (PARTITION BY a, b ORDER BY w) + (count(*) OVER (PARTITION BY a, b, w) - 1) / 2.0 rb FROM j) SELECT a, b, round(corr(ra, rb), 6) rho, count(*) n FROM r GROUP BY ALL""")
def _(s, d):
    r = runs(s, d).select("run", F.col("v").alias("m1"), F.col("cost").alias("m2"), F.col("seed").cast("double").alias("m3"))
    return res.correlations(r.unpivot(["run"], ["m1", "m2", "m3"], "metric", "x"), "run", "metric", "x")


@query("st29_within_group", W + RUNS + """, r AS (SELECT dataset, v, rank() OVER (PARTITION BY dataset ORDER BY v) + (count(*) OVER (PARTITION BY dataset, v) - 1) / 2.0 ra, rank() OVER (PARTITION BY dataset ORDER BY cost) + (count(*) OVER (PARTITION BY dataset, cost) - 1) / 2.0 rb FROM runs)
SELECT dataset, round(corr(ra, rb), 6) rho FROM r GROUP BY dataset HAVING count(DISTINCT v) >= 3""")
def _(s, d):
    return res.within_group_spearman(runs(s, d), "dataset", "v", "cost")


@query("st31_gain_curves", W + RUNS + """, g AS (SELECT dataset, seed, median(v) v FROM runs WHERE status = 'ok' GROUP BY ALL), r AS (SELECT seed, v / max(v) FILTER (seed = 0) OVER (PARTITION BY dataset) q FROM g) SELECT seed, round(median(q), 6) median, round(quantile_cont(q, 0.25), 6) q25, round(quantile_cont(q, 0.75), 6) q75 FROM r GROUP BY seed""")
def _(s, d):
    g = res.ok(runs(s, d), "v").groupBy("dataset", "seed").agg(F.median("v").alias("v"))
    r = res.relative_to_baseline(g, "v", "seed", ["dataset"])
    return r.groupBy("seed").agg(F.median("relative").alias("median"), F.percentile("relative", 0.25).alias("q25"), F.percentile("relative", 0.75).alias("q75"))


@query("set01_union", W + RUNS + " SELECT run FROM runs WHERE seed < 3 UNION ALL SELECT run FROM runs WHERE seed >= 2 AND region = 1")
def _(s, d):
    r = runs(s, d)
    return r.filter("seed < 3").select("run").unionByName(r.filter("seed >= 2 and region = 1").select("run"))


@query("set07_set_algebra", W + MEDIANS + """ (SELECT dataset FROM wide WHERE v > 150000 INTERSECT SELECT dataset FROM wide WHERE v < 150000) EXCEPT SELECT dataset FROM wide WHERE "method" = '5-LOW' AND v > 155000""")
def _(s, d):
    w = wide(s, d)
    return w.filter("v > 150000").select("dataset").intersect(w.filter("v < 150000").select("dataset")).exceptAll(w.filter((F.col("method") == B) & (F.col("v") > 155000)).select("dataset"))


@query("win15_first_per_key", W + RUNS + " SELECT dataset, run, round(v, 4) v FROM runs QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY run) = 1", 4)
def _(s, d):
    w = Window.partitionBy("dataset").orderBy("run")
    return runs(s, d).withColumn("p", F.row_number().over(w)).filter("p = 1").select("dataset", "run", "v")


@query("top03_ordered_top", W + MEDIANS + ' SELECT dataset, "method", round(v, 4) v FROM wide ORDER BY v DESC, dataset, "method" LIMIT 20', 4)
def _(s, d):
    return wide(s, d).orderBy(F.desc("v"), "dataset", "method").limit(20)


@query("flt15_label_codes", W + MEDIANS + ' SELECT DISTINCT dataset, dense_rank() OVER (ORDER BY dataset) - 1 code FROM wide')
def _(s, d):
    return wide(s, d).select("dataset").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("dataset")) - 1)


@query("fn13_bands", W + RUNS + ", e AS (SELECT min(v) lo, max(v) hi FROM runs) SELECT run, greatest(0, least(9, floor((v - lo) / (hi - lo) * 10)))::BIGINT band FROM runs, e")
def _(s, d):
    r = runs(s, d)
    return r.crossJoin(F.broadcast(r.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))).select("run", scalars.band(F.col("v"), F.col("lo"), F.col("hi"), 10).alias("band"))


@query("fn24_content_key", W + MEDIANS + """ SELECT "method", substr(sha256(string_agg(dataset, ',' ORDER BY dataset)), 1, 16) AS content_key FROM wide GROUP BY ALL""")
def _(s, d):
    return wide(s, d).groupBy("method").agg(scalars.content_key(F.collect_list("dataset")).alias("content_key"))


@query("fn26_rule_level", W + MEDIANS + """, g AS (SELECT dataset, min(v) / max(v) q FROM wide GROUP BY ALL) SELECT dataset, CASE WHEN ln(q) < -0.2 THEN 2.5 WHEN ln(q) < -0.08 THEN 0.75 ELSE 0.0 END::DOUBLE alpha FROM g""")
def _(s, d):
    rule = F.lit('{"variant": "two_threshold", "t1": -0.2, "t2": -0.08, "low": 2.5, "mid": 0.75, "high": 0.0}')
    return wide(s, d).groupBy("dataset").agg((F.min("v") / F.max("v")).alias("q")).select("dataset", scalars.rule_level(F.col("q"), rule).alias("alpha"))


@query("fn27_smallest_alpha", W + MEDIANS + """, g AS (SELECT dataset, min(v) / max(v) q FROM wide GROUP BY ALL) SELECT dataset, (SELECT min(a) FROM (SELECT unnest([0.0, 0.5, 1.0, 2.0, 3.0])::DOUBLE a) WHERE a > 0 AND power(q, a) <= 0.8) alpha FROM g""")
def _(s, d):
    return wide(s, d).groupBy("dataset").agg((F.min("v") / F.max("v")).alias("q")).select("dataset", scalars.smallest_alpha(F.col("q"), 0.8, [0.0, 0.5, 1.0, 2.0, 3.0]).alias("alpha"))


@query("fn16_labels", """SELECT run, format('Run {} k={}', run, run % 7) AS label, CASE WHEN run % 2 = 0 THEN (run % 4) / 2.0 END::DOUBLE alpha FROM (SELECT o_orderkey run FROM orders)""")
def _(s, d):
    r = table(s, d, "orders").select(F.col("o_orderkey").alias("run"))
    name = F.concat(F.lit("run_"), F.col("run").cast("string"), F.lit("_k"), (F.col("run") % 7).cast("string"))
    text = F.when(F.col("run") % 2 == 0, F.concat(F.lit("alpha="), (F.col("run") % 4 / 2).cast("string"), F.lit(" (fitted)"))).otherwise("none")
    return r.select("run", scalars.label_of(name).alias("label"), scalars.alpha_of(text).alias("alpha"))


@query("snk09_done_counts", W + RUNS + " SELECT status, count(*) n FROM runs GROUP BY ALL")
def _(s, d):
    return sinks.done(runs(s, d))


@query("snk12_remove_rows", W + RUNS + """ SELECT count(*) n FROM runs WHERE NOT ("method" = '5-LOW' AND region IN (1, 2))""")
def _(s, d):
    return sinks.without(runs(s, d), method=[B], region=[1, 2]).agg(F.count(F.lit(1)).alias("n"))


@query("smp01_stratified_quota", W + RUNS + """, q AS (SELECT "method", count(*) c, sum(count(*)) OVER () t FROM runs GROUP BY ALL) SELECT "method", floor(c * 100 / t)::BIGINT quota FROM q""")
def _(s, d):
    q = runs(s, d).groupBy("method").agg(F.count(F.lit(1)).alias("c"))
    return q.withColumn("t", F.sum("c").over(Window.partitionBy())).select("method", F.floor(F.col("c") * 100 / F.col("t")).alias("quota"))


@query("smp13_best_mask", W + MEDIANS + ' SELECT dataset, "method", v = max(v) OVER (PARTITION BY dataset) AS best FROM wide')
def _(s, d):
    return wide(s, d).select("dataset", "method", (F.col("v") == F.max("v").over(Window.partitionBy("dataset"))).alias("best"))


@query("st33_speed_ratio", W + MEDIANS + """, m AS (SELECT "method", median(v) v FROM wide GROUP BY ALL) SELECT a."method", round(a.v / b.v, 6) ratio FROM m a, m b WHERE b."method" = '5-LOW'""")
def _(s, d):
    m = res.two_level_median(runs(s, d), "v")
    base = m.filter(F.col("method") == B).select(F.col("median").alias("base"))
    return m.crossJoin(F.broadcast(base)).select("method", (F.col("median") / F.col("base")).alias("ratio"))


FAMILIES = [("levels", "h1", "confirmatory", "v", "1-URGENT", "5-LOW"), ("levels", "h2", "confirmatory", "v", "2-HIGH", "5-LOW"), ("levels", "h3", "exploratory", "v", "3-MEDIUM", "5-LOW"), ("costs", "h4", "confirmatory", "cost", "1-URGENT", "5-LOW"), ("costs", "h5", "confirmatory", "cost", "none", "5-LOW")]
_ROWS = ", ".join(str(f) for f in FAMILIES)


@query("st20_families", W + MEDIANS + f""", fam AS (SELECT * FROM (VALUES {_ROWS}) f(family, hypothesis, role, metric, method_a, method_b)), long AS (SELECT dataset, "method" m, 'v' metric, v FROM wide UNION ALL SELECT dataset, "method", 'cost', v FROM costs)
, p AS (SELECT fam.*, a.dataset, a.v va, b.v vb, a.v - b.v diff FROM fam JOIN long a ON a.metric = fam.metric AND a.m = method_a JOIN long b ON b.metric = fam.metric AND b.m = method_b AND a.dataset = b.dataset), s AS (SELECT family, hypothesis, count(*) n, median(diff) median, avg(sign(diff)) delta_pair FROM p GROUP BY ALL)
, hl AS (SELECT x.family, x.hypothesis, median((x.diff + y.diff) / 2) hodges_lehmann FROM p x JOIN p y ON x.family = y.family AND x.hypothesis = y.hypothesis AND x.dataset <= y.dataset GROUP BY ALL), cd AS (SELECT x.family, x.hypothesis, avg(sign(x.va - y.vb)) cliffs_delta FROM p x JOIN p y ON x.family = y.family AND x.hypothesis = y.hypothesis GROUP BY ALL)
SELECT fam.*, n, round(median, 4) median, round(hodges_lehmann, 4) hodges_lehmann, round(cliffs_delta, 4) cliffs_delta, round(delta_pair, 4) delta_pair FROM fam LEFT JOIN s USING (family, hypothesis) LEFT JOIN hl USING (family, hypothesis) LEFT JOIN cd USING (family, hypothesis)""", 4)
def _(s, d):
    return family_tests(s, d).drop("p", "p_holm")


def family_tests(s, d):
    long = wide(s, d).withColumn("metric", F.lit("v")).unionByName(res.medians(runs(s, d), "cost").withColumn("metric", F.lit("cost")))
    names = "family string, hypothesis string, role string, metric string, method_a string, method_b string"
    return res.family_tests(long, s.createDataFrame(FAMILIES, names))


@query("st20_family_p")
def _(s, d):
    return family_tests(s, d).select("family", "hypothesis", "p", "p_holm")


@query("st18_dominated", W + RUNS + """ SELECT dataset, run, EXISTS (SELECT 1 FROM runs b WHERE b."method" = '5-LOW' AND b.dataset = a.dataset AND b.v >= a.v AND b.cost >= a.cost AND (b.v > a.v OR b.cost > a.cost)) dominated FROM runs a""")
def _(s, d):
    return res.dominated_by(runs(s, d), "dataset", "run", "method", B, "v", "cost")


@query("st26_reproduces", W + MEDIANS + """, a AS (SELECT "method", median(v) computed FROM wide GROUP BY ALL), b AS (SELECT "method", avg(v) reference FROM wide WHERE "method" <> '3-MEDIUM' GROUP BY ALL) SELECT "method", round(computed, 4) computed, round(reference, 4) reference, coalesce(abs(computed - reference) <= greatest(0.005 * abs(reference), 10), false) ok FROM a FULL JOIN b USING ("method")""", 4)
def _(s, d):
    w = wide(s, d)
    a, b = w.groupBy("method").agg(F.median("v").alias("x")), w.filter("method <> '3-MEDIUM'").groupBy("method").agg(F.avg("v").alias("x"))
    return res.reproduces(a, b, ["method"], "x", 0.005, 10.0)


@query("st30_properties", W + RUNS + """, u AS (SELECT dataset, median(v) target, count(*)::DOUBLE size, min(v)::DOUBLE low, max(cost)::DOUBLE top FROM runs GROUP BY ALL), l AS (UNPIVOT u ON size, low, top INTO NAME property VALUE x), r AS (SELECT property, rank() OVER (PARTITION BY property ORDER BY x) + (count(*) OVER (PARTITION BY property, x) - 1) / 2.0 rx, rank() OVER (PARTITION BY property ORDER BY target) + (count(*) OVER (PARTITION BY property, target) - 1) / 2.0 ry FROM l)
, c AS (SELECT property, corr(rx, ry) rho, count(*) n FROM r GROUP BY ALL) SELECT property, round(rho, 6) rho, n, row_number() OVER (ORDER BY abs(rho) DESC, property) = 1 strongest FROM c""")
def _(s, d):
    u = runs(s, d).groupBy("dataset").agg(F.median("v").alias("target"), F.count(F.lit(1)).alias("size"), F.min("v").alias("low"), F.max("cost").alias("top"))
    return res.strongest_property(u, "dataset", "target", ["size", "low", "top"])


@query("st32_panels", W + RUNS + """ SELECT 'all' panel, count(*) n, round(median(v), 4) v, round(median(cost), 4) cost FROM runs UNION ALL SELECT 'late', count(*), round(median(v), 4), round(median(cost), 4) FROM runs WHERE seed >= 5 UNION ALL SELECT 'urgent', count(*), round(median(v), 4), round(median(cost), 4) FROM runs WHERE "method" = '1-URGENT'""", 4)
def _(s, d):
    return res.panel_medians(runs(s, d), ["v", "cost"], {"all": F.lit(True), "late": F.col("seed") >= 5, "urgent": F.col("method") == A})


@query("st35_against_baseline", W + RUNS + """, m AS (SELECT dataset, seed, median(v) v FROM runs GROUP BY ALL), d AS (SELECT a.dataset, a.seed, a.v - b.v diff FROM m a JOIN m b ON a.dataset = b.dataset AND b.seed = 0 WHERE a.seed <> 0) SELECT seed, count(*) n, round(median(diff), 4) median, round(avg((diff > 0)::INT), 4) share_positive FROM d GROUP BY seed""", 4)
def _(s, d):
    return res.against_baseline(runs(s, d), "v", "seed", 0).drop("p")


@query("jn10_equivalent_starts", W + RUNS + """, p AS (SELECT dataset, seed, max(v) FILTER ("method" = '1-URGENT') va, max(v) FILTER ("method" = '5-LOW') vb FROM runs GROUP BY ALL HAVING va IS NOT NULL AND vb IS NOT NULL) SELECT count(*) n, round(median(abs(va - vb)), 4) median, round(max(abs(va - vb)), 4) largest FROM p""", 4)
def _(s, d):
    return res.equivalent_starts(runs(s, d), "method", A, B, ["dataset", "seed"], "v")


@query("agg09_family_best", W + MEDIANS + """, f AS (SELECT dataset, CASE WHEN "method" IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE 'rest' END family, v FROM wide) SELECT dataset, family, round(max(v), 4) best FROM f GROUP BY ALL""", 4)
def _(s, d):
    family = F.when(F.col("method").isin(A, "2-HIGH"), "high").otherwise("rest")
    return wide(s, d).groupBy("dataset", family.alias("family")).agg(F.max("v").alias("best"))


@query("st29_summary", W + RUNS + """, r AS (SELECT dataset, v, rank() OVER (PARTITION BY dataset ORDER BY v) + (count(*) OVER (PARTITION BY dataset, v) - 1) / 2.0 ra, rank() OVER (PARTITION BY dataset ORDER BY cost) + (count(*) OVER (PARTITION BY dataset, cost) - 1) / 2.0 rb FROM runs), c AS (SELECT dataset, corr(ra, rb) rho FROM r GROUP BY dataset HAVING count(DISTINCT v) >= 3)
, g AS (SELECT count(*) n, median(rho) median, min(rho) low, max(rho) high, count(*) FILTER (rho > 0) positive, count(*) FILTER (rho <> 0) m FROM c) SELECT n, round(median, 6) median, round(low, 6) low, round(high, 6) high, positive, round(least(1, 2 * list_sum(list_transform(range(0, least(positive, m - positive) + 1), lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1)))) / 2.0**m), 6) p FROM g""")
def _(s, d):
    return res.sign_summary(res.within_group_spearman(runs(s, d), "dataset", "v", "cost"), "rho")


@query("flt03_near", W + RUNS + " SELECT run FROM runs WHERE abs(v / 1000 - round(v / 1000)) <= 0.001")
def _(s, d):
    return runs(s, d).filter(scalars.near(F.col("v") / 1000, F.round(F.col("v") / 1000), 0.001)).select("run")


@query("flt04_substring", W + RUNS + " SELECT run FROM runs WHERE contains(dataset, 'IN') AND \"method\" LIKE '%H'")
def _(s, d):
    return runs(s, d).filter(F.col("dataset").contains("IN") & F.col("method").endswith("H")).select("run")


@query("flt05_name_parts", W + RUNS + """, n AS (SELECT run, 'map_alpha' || (seed / 4.0)::DECIMAL(9, 2) || '_' || lower(split_part("method", '-', 2)) || CASE WHEN seed % 3 = 0 THEN '_k' || seed ELSE '' END t FROM runs) SELECT run, regexp_extract(t, '^map_alpha([0-9.]+)_([a-z ]+?)(_k([0-9]+))?$', 1)::DOUBLE alpha, regexp_extract(t, '^map_alpha([0-9.]+)_([a-z ]+?)(_k([0-9]+))?$', 2) kind, nullif(regexp_extract(t, '^map_alpha([0-9.]+)_([a-z ]+?)(_k([0-9]+))?$', 4), '')::BIGINT k FROM n WHERE regexp_full_match(t, 'map_alpha([0-9.]+)_([a-z ]+?)(_k([0-9]+))?')""")
def _(s, d):
    tail = F.when(F.col("seed") % 3 == 0, F.concat(F.lit("_k"), F.col("seed").cast("string"))).otherwise("")
    text = F.concat(F.lit("map_alpha"), (F.col("seed") / 4).cast("decimal(9,2)").cast("string"), F.lit("_"), F.lower(F.split_part("method", F.lit("-"), F.lit(2))), tail)
    return scalars.name_parts(runs(s, d).select("run", text.alias("t")), "t", r"map_alpha([0-9.]+)_([a-z ]+?)(?:_k([0-9]+))?", {"alpha": "double", "kind": "string", "k": "long"}).drop("t")


@query("flt06_finite_positive", W + RUNS + " SELECT run FROM runs WHERE cost > 0 AND v > 0 AND NOT isnan(cost::DOUBLE) AND cost < 'inf'::DOUBLE")
def _(s, d):
    return runs(s, d).filter(scalars.finite_positive("cost", "v")).select("run")


@query("flt10_recode", W + RUNS + """ SELECT DISTINCT "method", CASE "method" WHEN '1-URGENT' THEN 'now' WHEN '5-LOW' THEN 'later' ELSE "method" END AS recoded FROM runs""")
def _(s, d):
    return runs(s, d).select("method", scalars.recode(F.col("method"), {A: "now", B: "later"}).alias("recoded")).distinct()


@query("flt12_eligible", W + RUNS + """, u AS (SELECT dataset, count(*) n, min(v) low, count(DISTINCT "method") m FROM runs GROUP BY ALL) SELECT dataset, n >= 500 enough, low > 1000 large, m = 5 complete, n >= 500 AND low > 1000 AND m = 5 eligible FROM u""")
def _(s, d):
    u = runs(s, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.count_distinct("method").alias("m"))
    return scalars.eligible(u, {"enough": F.col("n") >= 500, "large": F.col("low") > 1000, "complete": F.col("m") == 5}).drop("n", "low", "m")


@query("flt13_oriented", W + RUNS + ', l AS (UNPIVOT (SELECT run, v, cost FROM runs) ON v, cost INTO NAME metric VALUE x) SELECT run, metric, round(CASE WHEN metric = \'cost\' THEN -x ELSE x END, 4) x FROM l', 4)
def _(s, d):
    long = runs(s, d).select("run", "v", "cost").unpivot(["run"], ["v", "cost"], "metric", "x")
    return long.withColumn("x", scalars.oriented(F.col("metric"), F.col("x"), ["cost"]))


@query("set02_disjoint_union", W + RUNS + " SELECT run FROM runs WHERE seed < 3 UNION ALL SELECT run FROM runs WHERE seed > 6")
def _(s, d):
    r = runs(s, d)
    return sinks.disjoint_union(r.filter("seed < 3").select("run"), r.filter("seed > 6").select("run"), ["run"])


@query("set04_distinct_vectors", "SELECT id, label FROM (SELECT vec_id id, label, row_number() OVER (PARTITION BY list_transform(embedding[1:2], lambda v: round(v::DOUBLE, 1)) ORDER BY vec_id) p FROM embeddings) WHERE p = 1")
def _(s, d):
    x = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 2), lambda v: F.round(v, 1) + 0.0)
    return res.first_of_equal(table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", x.alias("x")), ["x"], "id").drop("x")


@query("top06_evenly_spaced", W + MEDIANS + """, o AS (SELECT dataset, "method", row_number() OVER (ORDER BY v, dataset, "method") - 1 p, count(*) OVER () n FROM wide), w AS (SELECT DISTINCT round_even(i * (n - 1) / 6.0, 0)::BIGINT p FROM o, (SELECT unnest(range(0, 7)) i)) SELECT dataset, "method", p place FROM o SEMI JOIN w USING (p)""")
def _(s, d):
    return res.evenly_spaced(wide(s, d), ["v", "dataset", "method"], 7).select("dataset", "method", "place")


@query("fn15_words", "SELECT k, w AS words FROM (SELECT unnest([0.0, 0.25, 1.0, 3.0, 10.0, 13.5, 17.0, 42.0])::DOUBLE k, unnest(['Zero', 'ZeroPointTwoFive', 'One', 'Three', 'Ten', 'OneThreePointFive', 'Seventeen', 'FourTwo']) w)")
def _(s, d):
    return s.createDataFrame([(k,) for k in (0.0, 0.25, 1.0, 3.0, 10.0, 13.5, 17.0, 42.0)], "k double").select("k", scalars.number_words(F.col("k")).alias("words"))


@query("fn15_three_digits", "SELECT k, t AS text FROM (SELECT unnest([0.0, 1234.0, 12.345, 0.00456, -0.9996])::DOUBLE k, unnest(['0', '1234', '12.3', '0.00456', '-1.000']) t)")
def _(s, d):
    return s.createDataFrame([(v,) for v in (0.0, 1234.0, 12.345, 0.00456, -0.9996)], "k double").select("k", scalars.significant(F.col("k"), 3).alias("text"))


@query("fn17_keys", W + RUNS + """ SELECT run, dataset || '__' || "method" || '__' || seed "key" FROM runs""")
def _(s, d):
    return runs(s, d).select("run", scalars.composite_key("dataset", "method", "seed").alias("key"))


SHORT = {"trustworthiness_": "trust_", "continuity_": "cont_", "knn_jaccard_": "jacc_"}


@query("fn19_short_keys", "SELECT k AS \"key\", s AS short FROM (SELECT unnest(['trustworthiness_k7', 'continuity_k20', 'knn_jaccard_k7']) k, unnest(['trust_k7', 'cont_k20', 'jacc_k7']) s)")
def _(s, d):
    keys = s.createDataFrame([(k,) for k in ("trustworthiness_k7", "continuity_k20", "knn_jaccard_k7")], "key string")
    return keys.select("key", scalars.short_key(F.col("key"), SHORT).alias("short"))


@query("m39_converged", W + MEDIANS + """ SELECT a.dataset, round(a.v / b.v, 6) ratio, a.v < 1.05 * b.v converged FROM wide a JOIN wide b ON a.dataset = b.dataset WHERE a."method" = '1-URGENT' AND b."method" = '5-LOW'""")
def _(s, d):
    return res.converged(diffs(s, d), "va", "vb", 1.05)


@query("m40_gap", W + MEDIANS + """, j AS (SELECT a.dataset, a.v sa, b.v sb, c.v ca, e.v cb FROM wide a JOIN wide b ON a.dataset = b.dataset AND a."method" = '1-URGENT' AND b."method" = '5-LOW' JOIN costs c ON c.dataset = a.dataset AND c."method" = '1-URGENT' JOIN costs e ON e.dataset = a.dataset AND e."method" = '5-LOW') SELECT dataset, round((sa - sb) / nullif(sb, 0), 6) gap, round(cb / nullif(ca, 0), 6) speed_up FROM j""")
def _(s, d):
    return res.approximation_gap(diffs(s, d), res.paired(res.medians(runs(s, d), "cost"), A, B))
