import random

import numpy as np

from pairloom.llm import quality


def test_learns_and_scores_every_row(spark, odd_docs, no_docs):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 8)))
    rows = [(1000 + i, " ".join(word().upper() + "!!" if i % 4 == 0 else word() for _ in range(rnd.randrange(5, 80)))) for i in range(400)]
    docs = odd_docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(1000 + i, int(i % 4 > 0)) for i in range(400)] + [(1, None), (None, 1)], "doc_id long, quality int")
    out = quality.predictions(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id >= 1000]
    assert len(held) > 40 and np.mean([r.predicted == ((r.doc_id - 1000) % 4 > 0) for r in held]) > 0.95
    assert quality.predictions(no_docs, labels).count() == 0
    assert quality.predictions(odd_docs, labels.limit(0)).count() == odd_docs.count()


def test_difference_is_that_of_the_densities():
    d = len(quality.STATISTICS)
    rnd = np.random.default_rng(0)
    cov = [(a := rnd.normal(size=(d, d))) @ a.T + np.eye(d) for _ in (0, 1)]
    mean, x = rnd.normal(size=(2, d)), rnd.normal(size=(5, d))
    factor = [np.linalg.cholesky(c) for c in cov]
    model = quality.Model(np.log([0.3, 0.7]), mean, np.array([np.linalg.inv(f) for f in factor]), np.array([np.log(np.diag(f)).sum() for f in factor]))
    log = [np.log(p) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.sum((x - m) @ np.linalg.inv(c) * (x - m), axis=1) for p, c, m in zip((0.3, 0.7), cov, mean)]
    assert np.allclose(model.difference(x), log[1] - log[0])


def slow_fit(x, y, pooled=0.1, diagonal=0.05):
    """Means, covariances and the curve by numpy over all rows at once."""
    d = x.shape[1]
    cov = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    common = sum((y == k).mean() * cov[k] for k in (0, 1))
    shrunk = []
    for k in (0, 1):
        share = min(1.0, pooled + d / (y == k).sum())
        c = (1 - share) * cov[k] + share * common
        shrunk.append((1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-3 * np.eye(d))
    log = [np.log(((y == k).sum() + 0.5) / (len(y) + 1)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", x - x[y == k].mean(0), np.linalg.inv(c), x - x[y == k].mean(0)) for k, c in zip((0, 1), shrunk)]
    t = np.sign(log[1] - log[0]) * np.sqrt(np.abs(log[1] - log[0]))
    best = min(((np.logaddexp(0, -(2 * y - 1) * (a * t + b)).sum() + 0.5e-2 * (a * a + b * b), a, b) for a in np.linspace(0, 9, 226) for b in np.linspace(-3, 3, 121)))
    return log[1] - log[0], best


def test_fit_agrees_with_all_rows_at_once(spark):
    d = len(quality.STATISTICS)
    rnd = np.random.default_rng(1)
    y = (rnd.random(600) < 0.4).astype(int)
    x = rnd.normal(size=(600, d)) @ rnd.normal(size=(d, d)) * 0.3 + 0.15 * y[:, None]
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(y, x)], "label int, x array<double>").repartition(5)
    model = quality.fit(rows)
    want, (_, a, b) = slow_fit(x, y)
    assert np.allclose(model.difference(x), want, atol=1e-6)
    assert 1 < a < 8 and abs(model.scale - a) < 0.05 and abs(model.shift - b) < 0.06


def test_labels_count_once_and_conflicts_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "Word " * (i % 9 + 1) + ("!!! " * 9 if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(40)]
    more = labels + labels[:7] * 5 + [(50, 0), (50, 1)]
    got = [sorted((r.doc_id, round(r.score, 9), r.predicted) for r in quality.predictions(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()) for rows in (labels, more)]
    assert got[0] == got[1]
