"""Exact resistances: against the pseudo-inverse, and beyond 2000 nodes."""

import numpy as np
import pytest

from pairloom.operators import graphs, resistance


def graph(spark, rows):
    return spark.createDataFrame(rows, "u long, v long, w double")


def test_exact_resistances_are_those_of_the_pseudo_inverse(spark):
    rng = np.random.default_rng(3)
    rows = [(5 * k, 5 * (k + 1), 1.0) for k in range(39)] + [(*sorted(5 * int(v) for v in rng.choice(40, 2, replace=False)), float(rng.random() + 0.1)) for _ in range(60)]
    rows += [(5, 5, 9.0), (10, 0, 2.0)]  # a loop, and an edge the other way
    lap = np.zeros((40, 40))
    for u, v, w in rows:
        a, b = u // 5, v // 5
        lap[[a, b], [a, b]] += w * (a != b)
        lap[[a, b], [b, a]] -= w * (a != b)
    m = np.linalg.pinv(lap)
    want = {(5 * i, 5 * j): m[i, i] + m[j, j] - 2 * m[i, j] for i in range(40) for j in range(i + 1, 40)}
    e = graph(spark, rows)
    got = {(r.i, r.j): r.d for r in graphs.resistance(e).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - d) < 1e-8 for p, d in want.items())
    over = {(r.i, r.j): r.d for r in resistance.over_edges(e).collect()}
    assert over.keys() == {(min(r[:2]), max(r[:2])) for r in rows if r[0] != r[1]} and all(abs(want[p] - d) < 1e-8 for p, d in over.items())


def test_more_than_2000_nodes(spark):
    n = 2101
    e = graph(spark, [(*sorted((k, (k + s) % n)), 1.0) for k in range(n) for s in (1, 61, 257)])
    r = resistance.over_edges(e).collect()
    assert len(r) == 3 * n and abs(sum(x.d for x in r) - (n - 1)) < 1e-6
    near = graphs.resistance(e).filter("j - i = 61").agg({"d": "max", "*": "count"}).first()
    assert near[1] == n - 61 and abs(near[0] - next(x.d for x in r if x.j - x.i == 61)) < 1e-7


def test_several_components_are_an_error(spark):
    with pytest.raises(ValueError, match="components"):
        graphs.resistance(graph(spark, [(0, 1, 1.0), (2, 3, 1.0)]))
