import itertools

import numpy as np
import pytest

from pairloom.functions import distributions as dist
from pairloom.functions import scalars
from pairloom.operators import results as res
from pyspark.sql import functions as F


def pairs(spark, diffs):
    return spark.createDataFrame([(f"d{i:02}", float(v)) for i, v in enumerate(diffs)], "dataset string, diff double")


def test_holm_known_answer_and_nulls(spark):
    t = spark.createDataFrame([("f", f"h{i}", p) for i, p in enumerate((0.01, 0.02, 0.03, 0.04, 0.05, None))], "family string, h string, p double")
    got = {r.h: r.p_holm for r in res.holm(t, "family", "p", "h").collect()}
    assert [round(got[f"h{i}"], 6) for i in range(5)] == [0.05, 0.08, 0.09, 0.09, 0.09] and got["h5"] is None


def test_sign_flip_known_answer_and_brute_force(spark):
    assert res.sign_flip(pairs(spark, [1, 1, 1, 1, -1])).first().p == 6 / 32
    d = np.random.default_rng(0).normal(0.3, 1, 9)
    brute = np.mean([np.dot(s, d) >= d.sum() - 1e-9 for s in itertools.product((1, -1), repeat=9)])
    assert abs(res.sign_flip(pairs(spark, d)).first().p - brute) < 1e-12


def test_pareto_front_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(f"g{i % 3}", i, float(rng.integers(6)), float(rng.integers(6))) for i in range(90)] + [("g0", 900, None, 9.0)]
    got = {r.item for r in res.pareto_front(spark.createDataFrame(rows, "g string, item long, a double, b double"), "g", "item", "a", "b").collect()}
    want = {i for g, i, a, b in rows if a is not None and not any(h == g and c is not None and c >= a and d >= b and (c > a or d > b) for h, _, c, d in rows)}
    assert got == want


def test_nearest_value_first_on_ties(spark):
    left = spark.createDataFrame([("k", 1, 0.5), ("k", 2, 9.0), ("none", 3, 1.0)], "key string, l long, a double")
    right = spark.createDataFrame([("k", 0, 0.0), ("k", 1, 1.0), ("k", 2, 1.0)], "key string, r long, b double")
    got = {r.l: r.nearest_id for r in res.nearest_by_value(left, right, "key", "a", "b", "r").collect()}
    assert got == {1: 0, 2: 1, 3: None}


def test_null_keys_keep_their_baseline(spark):
    r = spark.createDataFrame([(None, 0, 21.0), (None, 1, 11.0), ("a", 0, 0.0), ("a", 1, 5.0)], "alpha string, lam int, v double")
    got = {(x.alpha, x.lam): x.relative for x in res.relative_to_baseline(r, "v", "lam", ["alpha"]).collect()}
    assert got[None, 1] == 11 / 21 and got["a", 1] is None
    more = r.unionByName(spark.createDataFrame([("none", 1, 3.0)], "alpha string, lam int, v double"))
    assert "none" not in {x.alpha for x in res.relative_to_baseline(more, "v", "lam", ["alpha"]).collect()}


def test_two_samples(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 12), rng.integers(2, 11, 15)
    wide = spark.createDataFrame([(f"d{i}", m, float(v)) for m, s in (("a", a), ("b", b)) for i, v in enumerate(s)], "dataset string, method string, v double")
    assert abs(res.cliffs_delta(wide, "a", "b").first().delta - np.sign(a[:, None] - b[None]).mean()) < 1e-12
    d = rng.normal(size=11)
    walsh = [(d[i] + d[j]) / 2 for i in range(11) for j in range(i, 11)]
    assert abs(res.hodges_lehmann(pairs(spark, d)).first().hodges_lehmann - np.median(walsh)) < 1e-12


def test_published_summary(spark):
    s = res.summary(pairs(spark, [1.0, 2.0, 4.0, -1.0])).first()
    assert (s.median, s.mean, s.share_positive, s.mad) == (1.5, 1.5, 0.75, 1.5)


def test_wilcoxon_is_exact_for_few_and_needs_five(spark):
    assert res.wilcoxon(pairs(spark, [1, 2, 3])).first().p is None
    assert res.wilcoxon(pairs(spark, [0.0] * 6)).first().p is None
    for d in ([1, -2, 3, 4, -5, 6, 7], [-3.5, 1, 2, 4, 9, 12]):
        r = res.wilcoxon(pairs(spark, d)).first()
        ranks = {v: k + 1 for k, v in enumerate(sorted(map(abs, d)))}
        w = sum(ranks[abs(v)] for v in d if v > 0)
        sums = [sum(k for k, s in zip(range(1, len(d) + 1), c) if s) for c in itertools.product((0, 1), repeat=len(d))]
        p = min(1.0, 2 * min(sum(x <= w for x in sums), sum(x >= w for x in sums)) / len(sums))
        assert r.exact and r.w_plus == w and abs(r.p - p) < 1e-12
    tied = res.wilcoxon(pairs(spark, [1, 1, -1, 2, 3, 0])).first()
    assert not tied.exact and tied.n == 6 and tied.n_nonzero == 5 and 0 < tied.p < 1


def test_sign_flip_alternatives_and_dispatch(spark):
    d = np.random.default_rng(4).normal(0.4, 1, 10)
    sums = np.array([np.dot(s, np.abs(d)) for s in itertools.product((1, -1), repeat=10)])
    want = {"greater": np.mean(sums >= d.sum() - 1e-9), "less": np.mean(sums <= d.sum() + 1e-9), "two-sided": min(1.0, 2 * np.mean(sums >= abs(d.sum()) - 1e-9))}
    for a, p in want.items():
        exact = res.sign_flip(pairs(spark, d), a).first()
        drawn = res.sign_flip(pairs(spark, d), a, most=5, draws=20_000, seed=1).first()
        assert exact.exact and abs(exact.p - p) < 1e-12 and not drawn.exact and drawn.n == 10
        if a != "two-sided":
            assert abs(drawn.p - p) < 0.015
    many = res.sign_flip(pairs(spark, np.random.default_rng(5).normal(0.1, 1, 60))).first()
    assert many.n == 60 and not many.exact and 0 < many.p < 1
    assert res.sign_flip(pairs(spark, [0.0, 0.0])).first().p is None
    with pytest.raises(ValueError):
        res.sign_flip(pairs(spark, d), "other")


def test_critical_difference_for_any_number_of_methods(spark):
    # Published upper 5 % points of the range over root 2: 2, 5, 10 and 20 methods.
    for k, q in ((2, 1.960), (5, 2.728), (10, 3.164), (20, 3.544)):
        r = spark.createDataFrame([(f"m{i}", float(i), 12) for i in range(k)], "method string, avg_rank double, n int")
        assert abs(res.critical_difference(r).first().cd - q * (k * (k + 1) / 72) ** 0.5) < 2e-3 * k
    assert res.critical_difference(spark.createDataFrame([("a", 1.0, 3)], "method string, avg_rank double, n int")).first().cd is None


def test_families_by_hand(spark):
    long = [(f"d{i}", m, "v", float(x)) for m, xs in (("a", (3, 4, 5, 6)), ("b", (1, 5, 2, 2))) for i, x in enumerate(xs)]
    names = "family string, hypothesis string, role string, metric string, method_a string, method_b string"
    fam = spark.createDataFrame([("f", "h1", "confirmatory", "v", "a", "b"), ("f", "h2", "confirmatory", "v", "a", "none")], names)
    got = {r.hypothesis: r for r in res.family_tests(spark.createDataFrame(long, "dataset string, method string, metric string, v double"), fam).collect()}
    h = got["h1"]
    assert (h.n, h.median, h.delta_pair) == (4, 2.5, 0.5) and abs(h.cliffs_delta - 11 / 16) < 1e-12 and h.p_holm == h.p
    assert h.hodges_lehmann == np.median([(a + b) / 2 for i, a in enumerate((2, -1, 3, 4)) for b in (2, -1, 3, 4)[i:]])
    assert got["h2"].n is None and got["h2"].p_holm is None


def test_dominated_by_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(f"g{i % 2}", i, "cd"[int(rng.integers(2))], float(rng.integers(5)), float(rng.integers(5))) for i in range(60)] + [("g0", 99, "d", None, 1.0)]
    got = {r.item: r.dominated for r in res.dominated_by(spark.createDataFrame(rows, "g string, item long, f string, a double, b double"), "g", "item", "f", "c", "a", "b").collect()}
    want = {i: a is not None and any(h == g and e == "c" and c >= a and d >= b and (c > a or d > b) for h, _, e, c, d in rows if c is not None) for g, i, _, a, b in rows}
    assert got == want


@pytest.mark.parametrize(("f", "args", "value"), [(dist.gamma_upper, (2.0, 4.743864518), 0.05), (dist.t_upper, (2.228138852, 10), 0.025), (dist.binomial_both, (2, 10), 0.109375), (dist.beta_lower, (2, 3, 0.4), 0.5248)])
def test_tail_probabilities(f, args, value):
    assert abs(f(*args) - value) < 1e-7


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.alpha_of(F.lit("alpha=1.5 (x)")).alias("a"), scalars.alpha_of(F.lit("none")).alias("b"), scalars.label_of(F.lit("some_name_k7")).alias("c"), scalars.hms(F.lit(3725.9)).alias("d"),
        scalars.first_difference(F.lit(5), F.lit(4)).alias("e"), scalars.fidelity(F.lit(None).cast("double")).alias("f"), scalars.escape_tex(F.lit("a_b%")).alias("g"), scalars.fold_angle(F.lit(170.0)).alias("h"),
        scalars.rule_level(F.lit(0.05), F.lit('{"variant": "two_threshold", "t1": -2.214482722197313, "t2": -1.6491148519193841, "low": 2.5, "mid": 0.75, "high": 0.0}')).alias("i"),
        scalars.smallest_alpha(F.lit(0.5), 0.3, [0.0, 1.0, 2.0]).alias("j"), scalars.band(F.lit(10.0), F.lit(0.0), F.lit(10.0), 4).alias("k"),
    ).first()
    assert tuple(row) == (1.5, None, "Some Name k=7", "1:02:05", 1, None, "a\\_b\\%", 10.0, 2.5, 2.0, 3)
