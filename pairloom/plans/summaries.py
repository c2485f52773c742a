"""Queries behind report numbers and figure tables: level counts, unions of grids, lookups, pairings and panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import geometry as geo
from ..operators import results as res
from ..operators import tables as tb
from .experiments import A, B, PAIRED, diffs, wide
from .registry import query
from .tables import MEDIANS, POINTS, RUNS, points, runs

W = "WITH "
LEVEL = "CASE WHEN ln(q) < -0.2 THEN 2.5 WHEN ln(q) < -0.08 THEN 0.75 ELSE 0.0 END"
SPREADS = MEDIANS + ", q AS (SELECT dataset, min(v) / max(v) q FROM wide GROUP BY ALL)"
RULE = '{"variant": "two_threshold", "t1": -0.2, "t2": -0.08, "low": 2.5, "mid": 0.75, "high": 0.0}'


def levels(s, d):
    """``dataset, alpha``: the level that the rule gives each data set."""
    q = wide(s, d).groupBy("dataset").agg((F.min("v") / F.max("v")).alias("q"))
    return q.select("dataset", scalars.rule_level(F.col("q"), F.lit(RULE)).alias("alpha"))


@query("r04_level_counts", W + SPREADS + f" SELECT l AS level, count(*) FILTER (abs(({LEVEL}) - l) <= 1e-9) n FROM q, (SELECT unnest([0.0, 0.75, 2.5])::DOUBLE l) GROUP BY l")
def _(s, d):
    return tb.level_counts(levels(s, d), "alpha", [0.0, 0.75, 2.5], 1e-9)


@query("r05_no_gain", W + MEDIANS + f""", f AS (SELECT dataset, arg_min(v - 150000, "method") first FROM wide GROUP BY dataset), g AS (SELECT f.* FROM f JOIN (SELECT dataset FROM (SELECT dataset, min(v) / max(v) q FROM wide GROUP BY ALL) WHERE ({LEVEL}) = 0) USING (dataset)) SELECT count(*) n, count(*) FILTER (first <= 0) no_gain, round(max(first), 4) largest FROM g""", 4)
def _(s, d):
    first = wide(s, d).groupBy("dataset").agg(F.min_by(F.col("v") - 150000, "method").alias("first"))
    high = levels(s, d).filter("alpha = 0").select("dataset")
    return first.join(high, "dataset", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") <= 0).alias("no_gain"), F.max("first").alias("largest"))


@query("r06_grid_extension", W + RUNS + """, g AS (SELECT dataset, seed, median(v) v FROM runs GROUP BY ALL), o AS (SELECT dataset, arg_max(seed, v) old FROM (SELECT * FROM g WHERE seed <= 5 ORDER BY seed) GROUP BY dataset), u AS (SELECT dataset, seed best FROM g QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY v DESC, seed) = 1), p AS (SELECT dataset, seed old FROM g WHERE seed <= 5 QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY v DESC, seed) = 1)
SELECT dataset, old, best, old = 5 at_cap, best > 5 beyond FROM p JOIN u USING (dataset)""")
def _(s, d):
    g = runs(s, d).groupBy("dataset", "seed").agg(F.median("v").alias("v"))
    return tb.extended_optimum(g.filter("seed <= 5"), g.filter("seed > 5"), "dataset", "seed", "v", 5)


@query("r07_first_row", W + MEDIANS + ' SELECT "method", round(avg(v), 4) v FROM wide GROUP BY ALL ORDER BY "method" LIMIT 1', 4)
def _(s, d):
    return wide(s, d).groupBy("method").agg(F.avg("v").alias("v")).orderBy("method").limit(1)


@query("r08_groups", W + RUNS + """, k AS (SELECT run, dataset || CASE WHEN seed % 2 = 0 THEN '__near' ELSE '__far' END AS name, v, "method" FROM runs), g AS (SELECT split_part(name, '__', 2) metric, CASE WHEN contains(split_part(name, '__', 1), ' ') THEN 'long' ELSE 'short' END AS size, "method", v FROM k WHERE contains(name, '__')) SELECT size, metric, "method", count(*) n, round(median(v), 4) median FROM g GROUP BY ALL""", 4)
def _(s, d):
    named = runs(s, d).select("method", "v", F.concat("dataset", F.when(F.col("seed") % 2 == 0, "__near").otherwise("__far")).alias("name"))
    return tb.by_name_parts(named, "name", lambda base: F.when(base.contains(" "), "long").otherwise("short")).groupBy("size", "metric", "method").agg(F.count(F.lit(1)).alias("n"), F.median("v").alias("median"))


@query("r12_pairing", W + RUNS + """, m AS (SELECT dataset, "method", seed, median(v) stab, median(cost) qual FROM runs GROUP BY ALL), b AS (SELECT * FROM m WHERE "method" = '5-LOW'), o AS (SELECT * FROM m WHERE "method" = '1-URGENT'), p AS (SELECT b.dataset, b.seed, b.qual qb, o.stab so, b.stab sb, o.qual qo FROM b JOIN o USING (dataset) QUALIFY row_number() OVER (PARTITION BY b.dataset, b.seed ORDER BY abs(b.stab - o.stab), o.seed) = 1)
SELECT count(*) n, count(*) FILTER (so <= sb AND qo <= qb AND (so < sb OR qo < qb)) dominated, round(median(100 * (qb - qo) / qb), 4) gain FROM p""", 4)
def _(s, d):
    m = runs(s, d).groupBy("dataset", "method", "seed").agg(F.median("v").alias("stab"), F.median("cost").alias("qual"))
    left = m.filter(F.col("method") == B).select("dataset", "seed", "stab", "qual")
    right = m.filter(F.col("method") == A).select("dataset", F.col("seed").alias("other"), F.col("stab").alias("s2"), F.col("qual").alias("q2"))
    return tb.paired_by_nearest(left, right)


@query("r13_constancy", W + RUNS + """, c AS (SELECT dataset, count(DISTINCT region) k FROM runs GROUP BY ALL) SELECT count(*) groups, count(*) FILTER (k = 1) constant_groups, round(2.0 / 1024, 6) least_p FROM c""")
def _(s, d):
    return tb.constancy(runs(s, d), "dataset", "region").withColumn("least_p", F.lit(2.0 / 1024))


@query("r16_rule_fields", """SELECT 'two_threshold' AS variant, -0.2::DOUBLE t1, -0.08::DOUBLE t2, 2.5::DOUBLE low, 0.75::DOUBLE mid, 0.0::DOUBLE high""")
def _(s, d):
    return s.createDataFrame([(RULE,)], "rule string").select(F.from_json("rule", "variant string, t1 double, t2 double, low double, mid double, high double").alias("r")).select("r.*")


@query("r16_worse_than", W + PAIRED + ", m AS (SELECT median(va) m FROM diffs) SELECT count(*) n, count(*) FILTER (vb < m) worse FROM diffs, m")
def _(s, d):
    p = diffs(s, d)
    return p.crossJoin(F.broadcast(p.agg(F.median("va").alias("m")))).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vb") < F.col("m")).alias("worse"))


@query("r18_unique_row", W + RUNS + " SELECT run, round(v, 2) v FROM runs WHERE run = (SELECT min(run) FROM runs)", 2)
def _(s, d):
    r = runs(s, d)
    first = r.agg(F.min("run").alias("run"))
    return tb.only_row(r.join(F.broadcast(first), "run", "left_semi").select("run", "v"))


@query("r21_at_grid_edge", W + RUNS + """, e AS (SELECT min("method") lowest FROM runs) SELECT dataset, round(avg(("method" = lowest)::INT), 6) share FROM runs, e GROUP BY dataset""")
def _(s, d):
    r = runs(s, d)
    edge = r.agg(F.min("method").alias("lowest"))
    return r.crossJoin(F.broadcast(edge)).groupBy("dataset").agg(F.avg((F.col("method") == F.col("lowest")).cast("double")).alias("share"))


@query("r23_datasets_with_empty_note", W + RUNS + """, n AS (SELECT dataset, CASE WHEN min(v) < 1500 THEN 'small' ELSE '' END note FROM runs GROUP BY ALL) SELECT count(DISTINCT dataset) n FROM n WHERE note = ''""")
def _(s, d):
    note = runs(s, d).groupBy("dataset").agg(F.when(F.min("v") < 1500, "small").otherwise("").alias("note"))
    return note.filter("note = ''").agg(F.count_distinct("dataset").alias("n"))


@query("r24_kind_by_regime", W + SPREADS + f", k AS (SELECT dataset, region, {LEVEL} AS level, CASE WHEN region = 4 THEN NULL ELSE region % 2 = 0 END synthetic FROM q JOIN (SELECT DISTINCT dataset, region FROM runs) USING (dataset)) SELECT level::DOUBLE AS level, count(*) FILTER (synthetic) synthetic, count(*) FILTER (NOT synthetic) real_, count(*) FILTER (synthetic IS NULL) unknown FROM k GROUP BY level")
def _(s, d):
    region = runs(s, d).select("dataset", "region").distinct()
    kind = F.when(F.col("region") != 4, F.col("region") % 2 == 0)
    return tb.kinds(levels(s, d).join(region, "dataset").withColumn("synthetic", kind), "alpha", "synthetic").withColumnRenamed("alpha", "level")


@query("r25_violations", W + PAIRED + " SELECT va > vb + 1e-9 + 1e-6 * abs(vb) AS violated, count(*) n, round(median(va / vb), 6) tightness FROM diffs GROUP BY ALL")
def _(s, d):
    violated = F.col("va") > F.col("vb") + 1e-9 + 1e-6 * F.abs("vb")
    return diffs(s, d).groupBy(violated.alias("violated")).agg(F.count(F.lit(1)).alias("n"), F.median(F.col("va") / F.col("vb")).alias("tightness"))


@query("r25_pooled_spearman", W + RUNS + ", r AS (SELECT rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 a, rank() OVER (ORDER BY cost) + (count(*) OVER (PARTITION BY cost) - 1) / 2.0 b FROM runs) SELECT round(corr(a, b), 6) rho, count(*) n FROM r")
def _(s, d):
    r = geo.global_ranks(runs(s, d).select("v", "cost"), {"v": "a", "cost": "b"})
    return r.agg(geo.pearson("a", "b").alias("rho"), F.count(F.lit(1)).alias("n"))


@query("r26_scenarios", W + RUNS + """ SELECT region::BIGINT scenario, "method", round(median(v), 4) median, round(median(cost), 4) cost, count(*) n FROM runs WHERE status = 'ok' AND "method" IN ('1-URGENT', '5-LOW') AND region < 3 GROUP BY ALL""", 4)
def _(s, d):
    r = res.ok(runs(s, d), "v").filter(F.col("method").isin(A, B) & (F.col("region") < 3))
    return r.groupBy(F.col("region").alias("scenario"), "method").agg(F.median("v").alias("median"), F.median("cost").alias("cost"), F.count(F.lit(1)).alias("n"))


@query("r28_panel_lookup", W + RUNS + """ SELECT 'late' panel, "method" policy, round(median(v), 4) v FROM runs WHERE seed >= 5 GROUP BY "method" UNION ALL SELECT 'early', "method", round(median(v), 4) FROM runs WHERE seed < 5 GROUP BY "method" """, 4)
def _(s, d):
    panel = F.when(F.col("seed") >= 5, "late").otherwise("early")
    return runs(s, d).groupBy(panel.alias("panel"), F.col("method").alias("policy")).agg(F.median("v").alias("v"))


@query("r29_included", W + RUNS + """, n AS (SELECT dataset, CASE WHEN count(*) FILTER (status = 'error') > 10 THEN 'errors' ELSE '' END note FROM runs GROUP BY ALL) SELECT count(*) FILTER (note = '') included, count(*) FILTER (note <> '') excluded FROM n""")
def _(s, d):
    n = runs(s, d).groupBy("dataset").agg(F.when(F.count_if(F.col("status") == "error") > 10, "errors").otherwise("").alias("note"))
    return n.agg(F.count_if(F.col("note") == "").alias("included"), F.count_if(F.col("note") != "").alias("excluded"))


@query("v05_plot_table", W + PAIRED + """, s AS (SELECT "method", median(v) median FROM wide GROUP BY ALL), t AS (SELECT '1-URGENT' "method", 0.03::DOUBLE p UNION ALL SELECT '2-HIGH', 0.2) SELECT s."method", round(median, 4) median, p, coalesce(p < 0.05, false) significant FROM s LEFT JOIN t USING ("method")""", 4)
def _(s, d):
    tests = s.createDataFrame([(A, 0.03), ("2-HIGH", 0.2)], "method string, p double")
    return tb.with_significance(wide(s, d).groupBy("method").agg(F.median("v").alias("median")), tests, "method", "p", 0.05)


@query("v07_pooled", W + RUNS + """ SELECT dataset, 'core' origin, region = 0 AS synthetic, round(median(v), 4) v FROM runs WHERE region < 3 GROUP BY dataset, region UNION ALL SELECT dataset, 'hold-out', region = 3, round(median(v), 4) FROM runs WHERE region >= 3 GROUP BY dataset, region""", 4)
def _(s, d):
    m = runs(s, d).groupBy("dataset", "region").agg(F.median("v").alias("v"))
    return tb.pooled(m.filter("region < 3"), m.filter("region >= 3"), F.col("region").isin(0, 3)).drop("region")


@query("v08_finite_positive", W + RUNS + " SELECT run, round(v, 2) v, round(cost, 2) cost FROM runs WHERE v > 0 AND cost > 0", 2)
def _(s, d):
    return runs(s, d).filter(scalars.finite_positive("v", "cost")).select("run", "v", "cost")


@query("v10_boxes", W + RUNS + """, l AS (UNPIVOT (SELECT region, "method", v, cost FROM runs WHERE status = 'ok') ON v, cost INTO NAME metric VALUE x) SELECT region::BIGINT scenario, "method", metric, round(x, 2) x FROM l""", 2)
def _(s, d):
    r = runs(s, d).filter("status = 'ok'").select(F.col("region").alias("scenario"), "method", "v", "cost")
    return r.unpivot(["scenario", "method"], ["v", "cost"], "metric", "x")


@query("v13_bound_table", W + PAIRED + """, t AS (SELECT unnest([0.9, 1.0, 1.1])::DOUBLE tau) SELECT tau, count(*) FILTER (va / vb <= tau) n, bool_or(va / vb > tau) any_above, round(median(va / vb) FILTER (va / vb <= tau), 6) median FROM diffs, t GROUP BY tau""")
def _(s, d):
    q = F.col("va") / F.col("vb")
    taus = s.createDataFrame([(0.9,), (1.0,), (1.1,)], "tau double")
    return diffs(s, d).crossJoin(F.broadcast(taus)).groupBy("tau").agg(F.count_if(q <= F.col("tau")).alias("n"), F.bool_or(q > F.col("tau")).alias("any_above"), F.median(F.when(q <= F.col("tau"), q)).alias("median"))


@query("v14_regime_map", W + SPREADS + f""", b AS (SELECT dataset, "method" best FROM wide QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY v DESC, "method") = 1), k AS (SELECT dataset, min(region)::BIGINT region FROM runs GROUP BY ALL) SELECT dataset, round(q, 6) q, {LEVEL}::DOUBLE AS alpha, best, region FROM q JOIN b USING (dataset) JOIN k USING (dataset)""")
def _(s, d):
    w = wide(s, d)
    q = w.groupBy("dataset").agg((F.min("v") / F.max("v")).alias("q"))
    region = runs(s, d).groupBy("dataset").agg(F.min("region").alias("region"))
    return q.join(levels(s, d), "dataset").join(res.best_per_dataset(w).select("dataset", F.col("method").alias("best")), "dataset").join(region, "dataset")


@query("v16_by_size", W + RUNS + """, n AS (SELECT dataset, count(*) // 100 * 100 n FROM runs GROUP BY ALL) SELECT n, "method", round(median(v), 4) median FROM runs JOIN n USING (dataset) GROUP BY ALL""", 4)
def _(s, d):
    r = runs(s, d)
    n = r.groupBy("dataset").agg((F.floor(F.count(F.lit(1)) / 100) * 100).alias("n"))
    return r.join(n, "dataset").groupBy("n", "method").agg(F.median("v").alias("median"))


@query("v17_first_seed", W + RUNS + """ SELECT "method", run, round(v, 2) v FROM runs SEMI JOIN (SELECT "method", min(seed) seed FROM runs GROUP BY ALL) USING ("method", seed)""", 2)
def _(s, d):
    r = runs(s, d)
    return r.join(r.groupBy("method").agg(F.min("seed").alias("seed")), ["method", "seed"], "left_semi").select("method", "run", "v")


@query("v19_panel_sample", W + POINTS + ", r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY md5(id || ':7'), id) p, x FROM points) SELECT label::BIGINT AS label, id, round(x[1], 6) px, round(x[2], 6) py FROM r WHERE p <= 20")
def _(s, d):
    w = Window.partitionBy("label").orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(":7"))), "id")
    p = points(s, d).withColumn("p", F.row_number().over(w)).filter("p <= 20")
    return p.select("label", "id", F.col("y")[0].alias("px"), F.col("y")[1].alias("py"))


@query("v06_ellipses", W + POINTS + """, v AS (SELECT label, avg(x[1]) cx, avg(x[2]) cy, var_samp(x[1]) a, var_samp(x[2]) b, covar_samp(x[1], x[2]) c FROM points GROUP BY label)
SELECT label::BIGINT AS label, round(cx, 5) cx, round(cy, 5) cy, round(4 * sqrt((a + b) / 2 + sqrt(((a - b) / 2)**2 + c*c)), 5) width, round(4 * sqrt(greatest(0, (a + b) / 2 - sqrt(((a - b) / 2)**2 + c*c))), 5) height, round(degrees(atan2(2 * c, a - b)) / 2, 4) angle FROM v""", 5)
def _(s, d):
    return tb.ellipses(points(s, d), 2.0).withColumn("angle", F.round("angle", 4))


@query("smp01_stratified_sample", W + POINTS + ", c AS (SELECT label, count(*) c, sum(count(*)) OVER () t FROM points GROUP BY label), r AS (SELECT id, points.label, row_number() OVER (PARTITION BY points.label ORDER BY md5(id || ':42'), id) p FROM points) SELECT id, label::BIGINT AS label FROM r JOIN c USING (label) WHERE p <= greatest(1, floor(c * 100 / t))")
def _(s, d):
    return tb.stratified_sample(points(s, d).select("id", "label"), "id", "label", 100, 42)


@query("smp02_row_and_column_sample", W + POINTS + ", k AS (SELECT id FROM points ORDER BY md5(id || ':42'), id LIMIT 40) SELECT a.id i, b.id j FROM k a JOIN k b ON a.id < b.id")
def _(s, d):
    ids = tb.hash_sample(points(s, d).select("id"), "id", 40, 42)
    p = geo.pairs(points(s, d)).select("i", "j")
    return p.join(F.broadcast(ids.withColumnRenamed("id", "i")), "i", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "j")), "j", "left_semi")


@query("smp07_scope", W + RUNS + """ SELECT dataset, CASE WHEN region >= 3 THEN 'hold-out' ELSE 'core' END scope FROM (SELECT DISTINCT dataset, region FROM runs)""")
def _(s, d):
    u = runs(s, d).select("dataset", "region").distinct()
    held = u.filter("region >= 3").select("dataset")
    return tb.with_scope(u, held, "dataset").select("dataset", "scope")


@query("smp08_distinct_levels", W + RUNS + """, a AS (SELECT dataset, round(seed / 4.0 + (run % 2) * 1e-12, 9) level, min(run) first FROM runs GROUP BY ALL) SELECT dataset, level, row_number() OVER (PARTITION BY dataset ORDER BY first) - 1 place FROM a""")
def _(s, d):
    r = runs(s, d).select("dataset", (F.col("seed") / 4 + (F.col("run") % 2) * 1e-12).alias("level"), "run")
    return tb.distinct_levels(r, "dataset", "level", "run", 9)


@query("smp09_best_level", W + RUNS + """, g AS (SELECT dataset, seed, median(v) v FROM runs GROUP BY ALL) SELECT dataset, seed, round(v, 4) v, CASE WHEN seed <= 5 THEN 'first' ELSE 'second' END source FROM g QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY v DESC, seed) = 1""", 4)
def _(s, d):
    g = runs(s, d).groupBy("dataset", "seed").agg(F.median("v").alias("v")).withColumn("source", F.when(F.col("seed") <= 5, "first").otherwise("second"))
    return tb.best_level(g, "dataset", "seed", "v")


@query("smp10_null_median", W + RUNS + """ SELECT dataset, round(median(CASE WHEN status = 'error' AND region = 1 THEN v END), 4) v FROM runs GROUP BY dataset""", 4)
def _(s, d):
    return runs(s, d).groupBy("dataset").agg(F.median(F.when((F.col("status") == "error") & (F.col("region") == 1), F.col("v"))).alias("v"))


@query("smp11_guarded", W + RUNS + """ SELECT run, CASE WHEN seed <> 0 THEN round(v / seed, 6) END per_seed, round(v, 6) v FROM runs""")
def _(s, d):
    return runs(s, d).select("run", F.try_divide(F.col("v"), F.col("seed")).alias("per_seed"), "v")


@query("smp14_node_index", W + RUNS + ', e AS (SELECT DISTINCT dataset u, "method" v FROM runs), n AS (SELECT u node FROM e UNION SELECT v FROM e), i AS (SELECT node, row_number() OVER (ORDER BY node) - 1 k FROM n) SELECT a.k i, b.k j FROM e JOIN i a ON a.node = u JOIN i b ON b.node = v WHERE u <> v')
def _(s, d):
    e = runs(s, d).select(F.col("dataset").alias("u"), F.col("method").alias("v")).distinct()
    return tb.edge_index(e)


@query("smp16_deterministic", W + RUNS + " SELECT count(*) n, true same FROM runs")
def _(s, d):
    return tb.same_rows(runs(s, d), runs(s, d))


@query("smp16_one_row_differs", W + RUNS + " SELECT (SELECT count(*) FROM runs) n, false same FROM runs LIMIT 1")
def _(s, d):
    first, again = runs(s, d), runs(s, d)
    one = F.col("run") == again.agg(F.max("run")).first()[0]
    return tb.same_rows(first, again.withColumn("cost", F.when(one, F.col("cost") + 1).otherwise(F.col("cost"))))


@query("win12_label_spacing", W + MEDIANS + """, o AS (SELECT dataset, max(v) v FROM wide GROUP BY ALL) SELECT count(*) n FROM o""")
def _(s, d):
    kept = tb.spaced(wide(s, d).groupBy("dataset").agg(F.max("v").alias("v")), "dataset", "v", 0.0)
    return kept.agg(F.count(F.lit(1)).alias("n"))


@query("win12_label_spacing_greedy", "WITH RECURSIVE " + MEDIANS + """, r AS (SELECT dataset, v, row_number() OVER (ORDER BY v, dataset) k FROM (SELECT dataset, max(v) v FROM wide GROUP BY ALL))
, nxt AS (SELECT a.k, (SELECT min(b.k) FROM r b WHERE b.k > a.k AND b.v - a.v >= 2000) n FROM r a), pick(k) AS (SELECT 1::BIGINT UNION ALL SELECT n FROM pick JOIN nxt USING (k) WHERE n IS NOT NULL) SELECT dataset, round(v, 6) v FROM pick JOIN r USING (k)""")
def _(s, d):
    return tb.spaced(wide(s, d).groupBy("dataset").agg(F.max("v").alias("v")), "dataset", "v", 2000.0)
