"""Queries of reports and figures, bounds, truth and resampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import bounds, geometry as geo, nearby, pairwise, resampling as rs, results as res, truth
from .experiments import A, B, PAIRED, below, diffs, wide
from .registry import query
from .tables import MEDIANS, PAIRS, POINTS, RANKS, RUNS, pairs, points, runs

W = "WITH "
REF = PAIRS + ", ref AS (SELECT p.*, sqrt((a.x[3]-b.x[3])**2 + (a.x[4]-b.x[4])**2) d_ref FROM pairs p JOIN points a ON a.id = i JOIN points b ON b.id = j)"


@query("m29_block_bounds", W + REF + """, q AS (SELECT d_hi h, (d_hi - d_lo)**2 g, (d_hi - d_ref)**2 f, 1 / (d_hi + 0.1) w FROM ref), s AS (SELECT sum(w*g) sigma, sum(w*f) sigma_ref, coalesce(sum(g) FILTER (h <= 7), 0) near, coalesce(sum(f) FILTER (h <= 7), 0) nr, coalesce(sum(f) FILTER (h > 7 AND h < 8), 0) mr, coalesce(sum(f) FILTER (h >= 8), 0) fr, sum(7.1 / (h + 0.1) * f) bound_a, min(h) lo FROM q)
, b AS (SELECT *, 7.1 / (lo + 0.1) * nr + mr + 7.1 / 8.1 * fr bound_b FROM s) SELECT round(sigma, 4) sigma, round(sigma_ref, 4) sigma_ref, sigma <= sigma_ref + 1e-9 + 1e-6 * abs(sigma_ref) AS holds, round(near, 4) near, round(bound_a, 4) bound_a, round(bound_b, 4) bound_b, round(bound_a - near, 4) slack_a, round(bound_b - near, 4) slack_b,
round(near / nullif(bound_a, 0), 4) tight_a, round(near / nullif(bound_b, 0), 4) tight_b, round(near / nullif(nr, 0), 4) near_ratio, round(7.1 / 8.1, 4) predicted_factor FROM b""", 4)
def _(s, d):
    return pairwise.block_bounds(points(s, d), 1, 0.1, 7.0, 8.0)


@query("m30_scale_factors", W + PAIRS + " SELECT round(7.1 / 8.1, 6) r_eps, round(7.1 / (min(d_hi) + 0.1), 6) kappa_eps, round(ln(2.0 * ((SELECT count(*) FROM points) - 1)) / ln(8.1 / 7.1), 6) alpha_dagger FROM pairs")
def _(s, d):
    return bounds.scale_factors(pairs(s, d), 7.0, 8.0, 0.1)


@query("m31_gaps", W + REF + """, q AS (SELECT 1 / (d_hi + 0.1) w, (d_hi - d_ref)**2 e0, (d_hi - d_lo)**2 ea FROM ref), s AS (SELECT sum(e0) s00, sum(ea) s0a, sum(w*e0) sa0, sum(w*ea) saa, stddev_pop(w)/avg(w) c, stddev_pop(e0)/avg(e0) g0, stddev_pop(ea)/avg(ea) ga, corr(w, e0) r0, corr(w, ea) ra FROM q)
SELECT round(s0a/s00 - 1, 5) delta, round(sa0/saa - 1, 5) delta_prime, round(c, 5) weight_cv, round(ga, 5) gamma, round(ra, 5) r, round((s0a/s00) * (sa0/saa) - (1 + r0*c*g0) / (1 + ra*c*ga), 5) + 0.0 identity_residual, CASE WHEN c*ga < 1 THEN round((1 + c*g0) / (1 - c*ga) - 1, 5) END bound FROM s""", 5)
def _(s, d):
    return pairwise.gaps(points(s, d), 1, 0.1)


@query("m31_log_lambda", W + PAIRS + " SELECT round(ln(sum((d_hi - d_lo)**2 / (d_hi + 0.1)) / sum((d_hi - d_lo)**2)), 6) log_lambda, round((max(d_hi) + 0.1) / (min(d_hi) + 0.1) - 1, 6) sandwich FROM pairs")
def _(s, d):
    return pairwise.log_lambda(points(s, d), 1, 0.1)


@query("m32_local_index")
def _(s, d):
    return bounds.local_index_points(points(s, d).select(F.col("label").cast("string").alias("dataset"), "id", "x", "y"), 0.1)


CLUSTERS = PAIRS + ", t AS (SELECT least(ci, cj) ca, greatest(ci, cj) cb, avg(d_hi) truth, avg(d_lo) got FROM pairs WHERE ci <> cj GROUP BY ALL)"


def clusters(s, d):
    return pairwise.class_means(points(s, d)).withColumnsRenamed({"hi": "truth", "lo": "got"})


@query("m25_agreement", W + CLUSTERS + """, r AS (SELECT *, ln(got) - ln(truth) e, rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / 2.0 a, rank() OVER (ORDER BY got) + (count(*) OVER (PARTITION BY got) - 1) / 2.0 b FROM t), m AS (SELECT avg(e) m FROM r)
SELECT round(corr(truth, got), 6) pearson, round(corr(a, b), 6) spearman, round(1 - sum(truth*got)**2 / (sum(truth**2) * sum(got**2)), 6) stress, round(median(abs(e - m)), 6) log_ratio_error, round(max(e) - min(e), 6) log_distortion FROM r, m""")
def _(s, d):
    return truth.agreement(clusters(s, d))


@query("m25_cophenetic", W + CLUSTERS + " SELECT round(corr(length(bin(xor(ca, cb)))::DOUBLE, got), 6) cophenetic FROM t")
def _(s, d):
    u = scalars.first_difference(F.col("ca"), F.col("cb")).cast("double")
    return clusters(s, d).withColumn("u", u).agg(geo.pearson("u", "got").alias("cophenetic"))


@query("m25_geodesic", W + REF + """, g AS (SELECT d_ref truth, d_lo got FROM ref), e AS (SELECT avg(ln(got) - ln(truth)) m FROM g WHERE got > 0 AND truth > 0) SELECT round(1 - sum(truth*got)**2 / (sum(truth**2) * sum(got**2)), 6) stress, round(corr(truth, got), 6) pearson, round(median(abs(ln(got) - ln(truth) - m)) FILTER (got > 0 AND truth > 0), 6) log_ratio_error FROM g, e""")
def _(s, d):
    return pairwise.agreement(points(s, d), "z", "y")


@query("m25_triplets", W + CLUSTERS + """, j AS (SELECT a.truth t1, a.got g1, b.truth t2, b.got g2, c.truth t3, c.got g3 FROM t a JOIN t b ON a.ca = b.ca AND a.cb < b.cb JOIN t c ON c.ca = a.cb AND c.cb = b.cb)
SELECT round(avg((list_position([t1, t2, t3], least(t1, t2, t3)) = list_position([g1, g2, g3], least(g1, g2, g3)))::INT), 6) triplet_accuracy, count(*) triples FROM j""")
def _(s, d):
    return truth.triplet_accuracy(clusters(s, d))


@query("m25_radius_slope", W + POINTS + """, c AS (SELECT label, avg(x[1]) a, avg(x[2]) b, avg(x[3]) c, avg(x[4]) d FROM points GROUP BY label), r AS (SELECT label, sqrt(avg((x[1]-a)**2 + (x[2]-b)**2)) got, sqrt(avg((x[3]-c)**2 + (x[4]-d)**2)) truth FROM points JOIN c USING (label) GROUP BY label) SELECT round(regr_slope(ln(got), ln(truth)), 6) slope FROM r""")
def _(s, d):
    p = points(s, d)
    both = p.join(F.broadcast(geo.centroids(p)), "label").join(F.broadcast(geo.centroids(p, "z").withColumnRenamed("c", "c2")), "label")
    r = both.withColumn("e", geo.euclid("y", "c") ** 2).withColumn("f", geo.euclid("z", "c2") ** 2).groupBy("label").agg(F.sqrt(F.avg("e")).alias("got"), F.sqrt(F.avg("f")).alias("truth"))
    return truth.radius_slope(r)


@query("m25_aspect_error", W + POINTS + """, v AS (SELECT var_samp(x[1]) a, var_samp(x[2]) b, covar_samp(x[1], x[2]) k, var_samp(x[3]) c, var_samp(x[4]) d, covar_samp(x[3], x[4]) l FROM points)
SELECT round(abs(ln(((a+b)/2 + sqrt(((a-b)/2)**2 + k*k)) / ((a+b)/2 - sqrt(((a-b)/2)**2 + k*k))) / 2 - ln(((c+d)/2 + sqrt(((c-d)/2)**2 + l*l)) / ((c+d)/2 - sqrt(((c-d)/2)**2 + l*l))) / 2), 6) aspect_error FROM v""")
def _(s, d):
    return truth.aspect_error(points(s, d))


@query("st07_mc_sign_flip")
def _(s, d):
    return rs.mc_sign_flip(diffs(s, d), 2000, 42)


@query("st09_permutation_spearman")
def _(s, d):
    return rs.permutation_spearman(diffs(s, d), "va", "vb", "dataset", 500, 42)


@query("st10_cluster_slope")
def _(s, d):
    return rs.cluster_slope_interval(runs(s, d), "cost", "v", "dataset", 400, 42)


_SIGN = "list_sum(list_transform(range({k}, g.n + 1), lambda i: exp(lgamma(g.n + 1) - lgamma(i + 1) - lgamma(g.n - i + 1) + i * ln({p}) + (g.n - i) * ln(1 - {p}))))"


@query("st17_power", W + PAIRED + f""", m AS (SELECT median(diff) mu, stddev_samp(diff) sd, avg((diff > 0)::INT) sh FROM diffs), e AS (SELECT *, mu / sd e, {below('sqrt(2) * mu / sd')} - 0.5 a FROM m), g AS (SELECT unnest([10, 25, 50, 100])::BIGINT n), kk AS (SELECT g.n, (SELECT min(c) FROM (SELECT unnest(range(0, g.n + 1)) c) WHERE {_SIGN.format(k='c', p='0.5')} <= 0.05) k FROM g)
SELECT g.n, round({below('sqrt(3.0 * g.n) * a - 1.6448536269514722')}, 4) noether, round({below('sqrt(g.n) * e - 1.6448536269514722')}, 4) t, round({_SIGN.format(k='k', p='sh')}, 4) sign, CASE WHEN a > 0 THEN round((1.6448536269514722 + 0.8416212335729143)**2 / (3 * a * a), 2) ELSE 'inf'::DOUBLE END noether_n, CASE WHEN e > 0 THEN round((1.6448536269514722 + 0.8416212335729143)**2 / (e * e), 2) ELSE 'inf'::DOUBLE END t_n FROM g JOIN kk USING (n), e""", 4)
def _(s, d):
    t = rs.power_table(diffs(s, d), 0.05, 0.8, [10, 25, 50, 100])
    return t.withColumns({c: F.round(c, 2) for c in ("noether_n", "t_n")})


@query("st17_wilcoxon_power")
def _(s, d):
    return rs.wilcoxon_power(diffs(s, d), 0.05, [10, 25], 400, 42)


@query("st22_leave_one_out", W + PAIRED + """, g AS (SELECT unnest([100000.0, 130000.0, 150000.0, 170000.0])::DOUBLE t), f AS (SELECT h.dataset held, h.va hx, h.vb hy, t, avg(o.vb) FILTER (o.va < t) ml, avg(o.vb) FILTER (o.va >= t) mh, coalesce(sum(o.vb**2) FILTER (o.va < t) - sum(o.vb) FILTER (o.va < t)**2 / count(*) FILTER (o.va < t), 0) + coalesce(sum(o.vb**2) FILTER (o.va >= t) - sum(o.vb) FILTER (o.va >= t)**2 / count(*) FILTER (o.va >= t), 0) sse
FROM diffs h, g, diffs o WHERE o.dataset <> h.dataset GROUP BY ALL) SELECT held, t, round(CASE WHEN hx < t THEN ml ELSE mh END, 2) predicted, round(hy - CASE WHEN hx < t THEN ml ELSE mh END, 2) error FROM f QUALIFY row_number() OVER (PARTITION BY held ORDER BY round(sse, 0), t) = 1""", 2)
def _(s, d):
    return rs.leave_one_out(diffs(s, d).select("dataset", F.col("va").alias("x"), F.col("vb").alias("y")), [100000.0, 130000.0, 150000.0, 170000.0])


@query("st28_metric_clusters")
def _(s, d):
    r = runs(s, d).select("run", F.col("v").alias("m1"), F.col("cost").alias("m2"), F.col("seed").cast("double").alias("m3"), (F.col("v") + F.col("cost")).alias("m4"))
    return rs.average_linkage(res.correlations(r.unpivot(["run"], ["m1", "m2", "m3", "m4"], "metric", "x"), "run", "metric", "x"), 0.3)


@query("agg27_makespan")
def _(s, d):
    return rs.greedy_makespan(runs(s, d).select(F.col("run").alias("job"), (F.col("v") / 1000).alias("seconds")), 12)


@query("r02_medians_long", W + MEDIANS + """ SELECT 'median_' || "method" AS "name", round(median(v), 4) "value", 'runs' "source" FROM wide GROUP BY "method" """, 4)
def _(s, d):
    return res.two_level_median(runs(s, d), "v").select(F.concat(F.lit("median_"), "method").alias("name"), F.col("median").alias("value"), F.lit("runs").alias("source"))


@query("r11_relative_change", W + RUNS + """, g AS (SELECT "method", seed, median(v) v FROM runs WHERE status = 'ok' GROUP BY ALL) SELECT "method", seed, round(100 * (v / max(v) FILTER (seed = 0) OVER (PARTITION BY "method") - 1), 4) change FROM g""", 4)
def _(s, d):
    g = res.ok(runs(s, d), "v").groupBy("method", "seed").agg(F.median("v").alias("v"))
    return res.relative_to_baseline(g, "v", "seed", ["method"]).select("method", "seed", (100 * (F.col("relative") - 1)).alias("change"))


@query("r15_optimum_shares", W + MEDIANS + """, b AS (SELECT dataset, "method" FROM wide QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY v DESC, "method") = 1) SELECT "method", count(*) n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) share FROM b GROUP BY ALL""")
def _(s, d):
    n = res.best_per_dataset(wide(s, d)).groupBy("method").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("r20_value_range", W + RUNS + " SELECT round(min(v), 2) low, round(max(v), 2) high FROM runs", 2)
def _(s, d):
    return runs(s, d).agg(F.min("v").alias("low"), F.max("v").alias("high"))


@query("r22_median_of_differences", W + PAIRED + " SELECT round(median(diff), 4) median, count(*) n FROM diffs", 4)
def _(s, d):
    return diffs(s, d).agg(F.median("diff").alias("median"), F.count(F.lit(1)).alias("n"))


@query("r27_median_of_products", W + PAIRED + " SELECT round(median(va * vb / 1e6), 2) median, round(max(abs(diff)), 2) largest FROM diffs", 2)
def _(s, d):
    return diffs(s, d).agg(F.median(F.col("va") * F.col("vb") / 1e6).alias("median"), F.max(F.abs("diff")).alias("largest"))


@query("r30_at_cap", W + RUNS + ", c AS (SELECT dataset, count(*) n FROM runs GROUP BY ALL) SELECT count(*) FILTER (n = m) at_cap, max(n) FILTER (n < m) below FROM c, (SELECT max(n) m FROM c)")
def _(s, d):
    c = runs(s, d).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.max("n").alias("m")))).agg(F.count_if(F.col("n") == F.col("m")).alias("at_cap"), F.max(F.when(F.col("n") < F.col("m"), F.col("n"))).alias("below"))


@query("v01_quartiles_by_level", W + RUNS + " SELECT region::BIGINT AS region, seed, round(median(v), 4) median, round(quantile_cont(v, 0.25), 4) q25, round(quantile_cont(v, 0.75), 4) q75 FROM runs WHERE status = 'ok' GROUP BY ALL", 4)
def _(s, d):
    return res.ok(runs(s, d), "v").groupBy("region", "seed").agg(F.median("v").alias("median"), F.percentile("v", 0.25).alias("q25"), F.percentile("v", 0.75).alias("q75"))


@query("v03_pivot", W + MEDIANS + """ SELECT dataset, round(max(v) FILTER ("method" = '1-URGENT'), 4) urgent, round(max(v) FILTER ("method" = '5-LOW'), 4) low FROM wide GROUP BY ALL""", 4)
def _(s, d):
    return wide(s, d).groupBy("dataset").pivot("method", [A, B]).agg(F.max("v")).withColumnsRenamed({A: "urgent", B: "low"})


@query("v06_local_residual", W + PAIRS + ", b AS (SELECT i, d_hi, d_lo FROM pairs UNION ALL SELECT j, d_hi, d_lo FROM pairs) SELECT i, round(sum((d_hi - d_lo)**2) / sum(d_hi**2), 6) residual FROM b GROUP BY i")
def _(s, d):
    return pairwise.per_point_error(points(s, d)).select("i", "residual")


@query("v11_percent_and_span", W + MEDIANS + """, r AS (SELECT dataset, "method", 100 * (v / max(v) FILTER ("method" = '5-LOW') OVER (PARTITION BY dataset) - 1) pct FROM wide) SELECT "method", round(min(pct), 4) low, round(max(pct), 4) high, round(median(pct), 4) median FROM r GROUP BY ALL""", 4)
def _(s, d):
    base = F.max(F.when(F.col("method") == B, F.col("v"))).over(Window.partitionBy("dataset"))
    r = wide(s, d).select("method", (100 * (F.col("v") / base - 1)).alias("pct"))
    return r.groupBy("method").agg(F.min("pct").alias("low"), F.max("pct").alias("high"), F.median("pct").alias("median"))


@query("set05_knn_jaccard", W + RANKS + ", p AS (SELECT i, count(*) FILTER (r <= 7 AND q <= 7) m FROM ranks GROUP BY i) SELECT i, m AS common, round(m / (14.0 - m), 6) jaccard FROM p")
def _(s, d):
    return nearby.common(points(s, d), 7).select("i", F.col("m").alias("common"), (F.col("m") / (14.0 - F.col("m"))).alias("jaccard"))


@query("set06_intruders", W + RANKS + " SELECT i, j FROM ranks WHERE q <= 7 AND r > 7")
def _(s, d):
    return nearby.intruders(points(s, d), 7)


@query("smp02_hash_sample", W + POINTS + " SELECT id, label FROM points ORDER BY md5(id || ':42'), id LIMIT 100")
def _(s, d):
    key = F.md5(F.concat(F.col("id").cast("string"), F.lit(":42")))
    return points(s, d).orderBy(key, "id").limit(100).select("id", "label")


@query("smp17_sign_alignment", W + POINTS + " SELECT round(sign(sum(x[1] * x[3])), 1) s0, round(sign(sum(x[2] * x[4])), 1) s1 FROM points")
def _(s, d):
    return points(s, d).agg(*[F.signum(F.sum(F.col("y")[k] * F.col("z")[k])).alias(f"s{k}") for k in (0, 1)])


@query("win09_gaps", W + POINTS + ", a AS (SELECT id, label, degrees(atan2(x[2], x[1])) a FROM points), m AS (SELECT id, label, CASE WHEN a < 0 THEN a + 360 ELSE a END a FROM a) SELECT id, round(coalesce(lead(a) OVER (PARTITION BY label ORDER BY a, id), min(a) OVER (PARTITION BY label) + 360) - a, 6) gap FROM m")
def _(s, d):
    p = points(s, d).select("id", "label", F.pmod(F.degrees(F.atan2(F.col("y")[1], F.col("y")[0])), F.lit(360.0)).alias("a"))
    w = Window.partitionBy("label").orderBy("a", "id")
    return p.select("id", (F.coalesce(F.lead("a").over(w), F.min("a").over(Window.partitionBy("label")) + 360.0) - F.col("a")).alias("gap"))


@query("m33_slack_factors", W + REF + """, q AS (SELECT d_hi h, (d_hi - d_lo)**2 g, (d_hi - d_ref)**2 f, 1 / (d_hi + 0.1) w FROM ref), s AS (SELECT sum(w*g) sigma, sum(w*f) sref, sum(w*g) FILTER (h <= 7) snear, sum(g) FILTER (h <= 7) near, coalesce(sum(f) FILTER (h <= 7), 0) nr, coalesce(sum(f) FILTER (h > 7 AND h < 8), 0) mr, coalesce(sum(f) FILTER (h >= 8), 0) fr, sum(7.1 / (h + 0.1) * f) ba, min(h) lo FROM q)
SELECT round(sref / sigma, 4) s1, round(sigma / snear, 4) s2, round(7.1 * snear / near, 4) s3, round((7.1 / (lo + 0.1) * nr + mr + 7.1 / 8.1 * fr) / ba, 4) s4, round((sref / sigma) * (sigma / snear) * (7.1 * snear / near) * (near / ba) - 1, 4) + 0.0 "check" FROM s""", 4)
def _(s, d):
    return pairwise.slack_factors(points(s, d), 1, 0.1, 7.0, 8.0)


@query("m33_certificate", W + REF + """, b AS (SELECT 'first' AS "name", coalesce(sum((d_hi - d_lo)**2) FILTER (d_hi <= 7), 0) near, coalesce(sum((d_hi - d_lo)**2) FILTER (d_hi > 7 AND d_hi < 8), 0) mid, coalesce(sum((d_hi - d_lo)**2) FILTER (d_hi >= 8), 0) far FROM ref
UNION ALL SELECT 'second', coalesce(sum((d_hi - d_ref)**2) FILTER (d_hi <= 7), 0), coalesce(sum((d_hi - d_ref)**2) FILTER (d_hi > 7 AND d_hi < 8), 0), coalesce(sum((d_hi - d_ref)**2) FILTER (d_hi >= 8), 0) FROM ref), k AS (SELECT *, 1.5 * near + mid + 0.75 * far v FROM b)
SELECT round((SELECT near + 0.75 * mid FROM b WHERE "name" = 'first') / v - 1, 6) certified, "name" AS witness FROM k ORDER BY v, "name" LIMIT 1""")
def _(s, d):
    return bounds.certificate(pairwise.witness_blocks(points(s, d), 7.0, 8.0), "first", 1.0, 0.75, 1.5)
