"""Approximate nearest neighbours: a forest of random projections for a start, then neighbours of neighbours.

A tree deals the points to slabs of equal size along a random direction, over the whole table; within a slab random
hyperplanes through medians cut down to leaves, whose points meet. Then every point's neighbours, and some of those that
it is a neighbour of, meet at it, round after round, until hardly a list changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .lineage import cut_lineage, drop

_PAIRS = "i long, j long, d_hi double, met long"
_EMPTY = {"i": np.zeros(0, np.int64), "j": np.zeros(0, np.int64), "d": np.zeros(0)}


def _distances(x: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)
    return np.sqrt(np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0.0))


def _batch(ids: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray, met: int) -> pa.RecordBatch:
    """Pairs by places in ``ids``; the comparisons made stand in the first row."""
    count = np.zeros(len(i), np.int64)
    count[:1] = met
    return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j]), pa.array(d), pa.array(count)], names=["i", "j", "d_hi", "met"])


def _leaves(x: np.ndarray, leaf: int, rng: np.random.Generator):
    """Index arrays of at most ``leaf`` points: halves along random directions, by rank, so that equal points part too."""
    open_ = [np.arange(len(x))]
    while open_:
        at = open_.pop()
        if len(at) <= leaf:
            yield at
            continue
        a, b = x[rng.choice(at, 2, replace=False)]
        along = a - b if (a != b).any() else rng.normal(size=x.shape[1])
        order = at[np.argsort(x[at] @ along, kind="stable")]
        open_ += [order[: len(order) // 2], order[len(order) // 2 :]]


def _leaf_pairs(k: int, leaf: int, seeds: list[int]):
    def meet(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("id").to_numpy())
        ids = group.column("id").to_numpy()[order]
        x = np.array(group.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(ids), -1)[order]
        made, met = [], 0
        for at in _leaves(x, leaf, np.random.default_rng([*seeds, int(group.column("s")[0].as_py())])):
            d = _distances(x[at])
            np.fill_diagonal(d, np.inf)
            met += len(at) * (len(at) - 1) // 2
            near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(at) - 1)]
            i = np.repeat(np.arange(len(at)), near.shape[1])
            made.append((at[i], at[near.ravel()], d[i, near.ravel()]))
        i, j, d = (np.concatenate([m[c] for m in made]) for c in range(3))
        return pa.Table.from_batches([_batch(ids, i, j, d, met)])

    return meet


def forest(points: DataFrame, k: int, trees: int = 4, leaf: int = 48, slab: int = 4096, seed: int = 0) -> DataFrame:
    """``i, j, d_hi, met`` of pairs that share a leaf: each point's ``k`` nearest there, tree by tree."""
    n = points.count()
    dims = points.select(F.size("x").alias("n")).first()["n"]
    slabs = -(-n // slab)
    rng = np.random.default_rng(seed)
    out = None
    for tree in range(trees):
        axis = rng.normal(size=dims)
        along = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in axis]), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
        # Equal points share a place; a trifle by id lets them part, so that no slab holds a third of all.
        rows = points.select("id", "x", (along * (1 + F.pmod(F.xxhash64("id", F.lit(tree)), F.lit(1 << 20)) * 1e-12) + F.pmod(F.xxhash64("id"), F.lit(1 << 20)) * 1e-15).alias("p"))
        if slabs > 1:
            ends = rows.agg(F.percentile_approx("p", [e / slabs for e in range(1, slabs)], 100 * slabs)).first()[0]
            cut = F.aggregate(F.array(*[F.lit(float(e)) for e in ends]), F.lit(0), lambda s, e: s + (F.col("p") > e).cast("int"))
        else:
            cut = F.lit(0)

        found = rows.select("id", "x", cut.alias("s")).groupBy("s").applyInArrow(_leaf_pairs(k, leaf, [seed, tree]), _PAIRS)
        out = found if out is None else out.unionByName(found)
    return out


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """Each point's ``k`` nearest of the pairs, ties by id; a pair counts as new if all its rows are."""
    once = pairs.groupBy("i", "j").agg(F.min("d_hi").alias("d_hi"), F.min("new").alias("new"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d_hi", "j"))).filter(F.col("rank") <= k)


def _meetings(batches):
    """Of every point's visitors those pairs that are nearer than what one of them has, unless both were here before."""
    for batch in batches:
        for r in range(len(batch)):
            names, limit, fresh = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("ids", "limits", "fresh"))
            x = batch.column("x")[r].values.to_numpy(zero_copy_only=False).reshape(len(names), -1)
            d = _distances(x)
            fresh = fresh.astype(bool)
            open_ = fresh[:, None] | fresh[None]
            np.fill_diagonal(open_, False)
            i, j = np.nonzero(open_ & (d < limit[:, None]))
            yield _batch(names, i, j, d[i, j], int(np.triu(open_).sum()))


def approximate(points: DataFrame, k: int, spare: int = 10, trees: int = 4, leaf: int = 48, rounds: int = 12, enough: float = 0.002, seed: int = 0) -> tuple[DataFrame, int]:
    """``i, j, rank, d_hi`` of about the ``k`` nearest of ``id, x`` points, and the number of comparisons made.

    Lists are ``spare`` longer than asked for while they are made, which finds more of what is asked for. It ends when a round changes less than ``enough`` of all entries, or after ``rounds``. At a point meet its ``k``
    neighbours and up to ``k`` of the points that it is a neighbour of, those of the smallest hash: a hub's meeting is as small
    as any. Points fewer than k + 1 give what there is.
    """
    n, asked = points.count(), k
    k += spare
    at = points.select("id", F.col("x").cast("array<double>").alias("x"))
    compared = Observation()
    start = forest(at, k, trees, leaf, seed=seed).observe(compared, F.sum("met").alias("n"))
    lists = cut_lineage(_best(start.withColumn("new", F.lit(1)), k))
    total = compared.get["n"] or 0
    for turn in range(rounds):
        back = lists.withColumn("r", F.row_number().over(Window.partitionBy("j").orderBy(F.desc("new"), F.xxhash64("i", F.lit(turn)))))
        visits = lists.select(F.col("i").alias("u"), F.col("j").alias("m"), "new").unionAll(back.filter(F.col("r") <= k).select(F.col("j"), F.col("i"), "new")).groupBy("u", "m").agg(F.max("new").alias("new"))
        limit = lists.groupBy("i").agg(F.max("d_hi").alias("limit"), F.count(F.lit(1)).alias("c")).select(F.col("i").alias("m"), F.when(F.col("c") < min(k, n - 1), float("inf")).otherwise(F.col("limit")).alias("limit"))
        full = visits.join(at.withColumnRenamed("id", "m"), "m").join(limit, "m")
        met = full.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("m", "limit", "new", "x"))).alias("v"))
        met = met.select(F.col("v.m").alias("ids"), F.col("v.limit").alias("limits"), F.col("v.new").alias("fresh"), F.flatten("v.x").alias("x"))
        compared, changed = Observation(), Observation()
        found = met.mapInArrow(_meetings, _PAIRS).observe(compared, F.sum("met").alias("n")).select("i", "j", "d_hi", F.lit(1).alias("new"))
        old = lists.select("i", "j", "d_hi", F.lit(0).alias("new"))
        now = cut_lineage(_best(old.unionAll(found), k).observe(changed, F.sum("new").alias("n")))
        drop(lists)
        lists = now
        total += compared.get["n"] or 0
        if (changed.get["n"] or 0) <= enough * n * k:
            break
    return lists.filter(F.col("rank") <= asked).select("i", "j", "rank", "d_hi"), total


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact lists' distances that the found lists reach, rank by rank: ties may go either way."""
    both = exact.select("i", "rank", F.col("d_hi").alias("e")).join(found.select("i", "rank", F.col("d_hi").alias("f")), ["i", "rank"], "left")
    limit = exact.groupBy("i").agg(F.max("d_hi").alias("limit"))
    return both.join(limit, "i").agg(F.avg((F.col("f") <= F.col("limit") * (1 + 1e-9) + 1e-12).cast("double")).alias("r")).select(F.coalesce("r", F.lit(0.0)).alias("recall"))
