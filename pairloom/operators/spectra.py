"""Leading eigenpairs of doubly centred squared distances, without the matrix.

A product with the matrix takes the products of the points with the basis, summed over blocks, and then a pass over the blocks: it
grows with the points, not with their pairs. The basis stays with its blocks: the driver sees only its products with itself, some
dozens of numbers squared, and with the points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage, drop

BLOCK = 2048
_STATE = "b int, id array<long>, x array<double>, k array<double>"


def _columns(b: pa.RecordBatch, r: int, *names: str) -> list[np.ndarray]:
    return [b.column(n)[r].values.to_numpy(zero_copy_only=False) for n in names]


def _row(values: dict, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], types[n]) for n, v in values.items()], names=list(values))


_LIST = pa.list_(pa.float64())
_TYPES = {"b": pa.int32(), "id": pa.list_(pa.int64()), "x": _LIST, "k": _LIST, "w": _LIST, "m": _LIST}


def _mapped(state: DataFrame, each, schema: str) -> DataFrame:
    """Applies ``each(b, n, k, w, x) -> columns`` to every block of ``n`` points; ``w`` is None where the table has none."""
    has = "w" in state.columns

    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                ids, k = _columns(batch, r, "id", "k")
                n = len(ids)
                w = _columns(batch, r, "w")[0].reshape(n, -1) if has else None
                x = _columns(batch, r, "x")[0]
                made = each(batch.column("b")[r].as_py(), n, k.reshape(n, -1) if len(k) else np.zeros((n, 0)), w, x.reshape(n, -1))
                yield _row({"b": batch.column("b")[r].as_py(), "id": ids, "x": x, **made} if "id array" in schema else made, _TYPES)

    return state.mapInArrow(run, schema)


def _total(state: DataFrame, each, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over blocks of ``each(k, w, x)``, an array of ``shape``."""
    parts = _mapped(state, lambda b, n, k, w, x: {"m": each(k, w, x).ravel()}, "m array<double>")
    rows = parts.select(F.posexplode("m").alias("p", "v")).groupBy("p").agg(F.sum("v").alias("v")).collect()  # as many as the shape has
    out = np.zeros(int(np.prod(shape)))
    for p, v in rows:
        out[p] = v
    return out.reshape(shape)


def _product(state: DataFrame, width: int, mean: np.ndarray) -> DataFrame:
    """``state`` with ``w``: squared distances times the last ``width`` columns of the basis.

    With s the squared norms of centred points X, the squared distances are s 1' + 1 s' - 2 X X': three products of points with the
    columns, summed over blocks, are all that a block needs of the others.
    """

    def met(k, w, x):
        x, q = x - mean, k[:, -width:]
        return np.vstack([x.T @ q, (x * x).sum(1) @ q, q.sum(0)])

    t = _total(state, met, (len(mean) + 2, width))

    def each(b, n, k, w, x):
        x = x - mean
        return {"k": k.ravel(), "w": ((x * x).sum(1)[:, None] * t[-1] + t[-2] - 2.0 * x @ t[:-2]).ravel()}

    return _mapped(state, each, _STATE + ", w array<double>")


def leading_pairs(points: DataFrame, dims: int = 2, tol: float = 1e-8, cycles: int = 60, steps: int = 8, seed: int = 0, block: int = BLOCK) -> tuple[list[float], DataFrame]:
    """The ``dims`` largest eigenvalues of -1/2 J D^2 J, and ``id, v`` with their unit vectors, for ``id, x`` points.

    A block Krylov basis of ``steps`` products is made orthonormal, the small problem on it solved, and the best vectors
    start the next cycle, until no residual is above ``tol`` of the largest eigenvalue; ``cycles`` without that are an
    error. The largest entry of each vector is positive. Equal points share their entries; fewer points than ``dims`` + 1 are an error.
    """
    spark = points.sparkSession
    n = points.count()
    width = min(dims + 6, n - 1)
    if n <= dims:
        raise ValueError(f"{n} points have no {dims} axes")
    steps = max(1, min(steps, (n - 1) // width))
    blocks = -(-n // block)
    rows = points.select("id", F.col("x").cast("array<double>").alias("x")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = rows.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("id", "x"))).alias("r")).select("b", "r.id", F.flatten("r.x").alias("x"))
    blocks = max(1, blocks)
    state = _mapped(packed.withColumn("k", F.array().cast("array<double>")), lambda b, m, k, w, x: {"k": np.random.default_rng([seed, b]).normal(size=(m, width)).ravel()}, _STATE)
    state = cut_lineage(state)
    middle = _total(state, lambda k, w, x: x.sum(0), (len((r := state.first())["x"]) // len(r["id"]),)) / n

    def based(s: DataFrame, mean: np.ndarray, through: np.ndarray, extend: bool, centre: np.ndarray | None = None) -> DataFrame:
        """The basis times ``through``, or extended by the last product's new directions."""

        def each(b, m, k, w, x):
            if not extend:
                return {"k": ((k - mean) @ through).ravel()}
            new = (-0.5 * (w - mean) - k @ centre) @ through
            return {"k": np.hstack([k, new]).ravel()}

        return _mapped(s, each, _STATE)

    def whitened(gram: np.ndarray) -> np.ndarray:
        """What makes columns of this Gram matrix orthonormal; directions that are lost in rounding are left out."""
        values, vectors = np.linalg.eigh(gram)
        keep = values > max(values.max(), 0.0) * 1e-20
        turn = vectors[:, keep] / np.sqrt(values[keep])
        return turn @ vectors.T if keep.all() else turn  # nearly orthonormal columns stay what they are

    def orthonormal(s: DataFrame) -> DataFrame:
        m = len(s.first()["k"]) // len(s.first()["id"])
        for _ in range(2):  # once more, since the first turn is only as good as the Gram matrix
            both = _total(s, lambda k, w, x: np.vstack([k.sum(0), k.T @ k]), (m + 1, m))
            mean, gram = both[0] / n, both[1:]
            turn = whitened(gram - n * np.outer(mean, mean))
            s, m = cut_lineage(based(s, mean, turn, False)), turn.shape[1]
        return s

    first = orthonormal(state)
    drop(state)
    for _ in range(cycles):
        now, widths, h, held = first, [], {}, None
        width = len((r := first.first())["k"]) // len(r["id"])
        last = np.zeros((0, 0))
        for step in range(steps):
            made = cut_lineage(_product(now, width, middle))
            m = sum(widths) + width
            both = _total(made, lambda k, w, x: np.vstack([w.sum(0), k.T @ w]), (1 + m, width))
            mean, kw = both[0] / n, -0.5 * both[1:]  # the basis has no part along the constant vector, so means drop out
            beyond = lambda k, w, mean=mean, kw=kw: -0.5 * (w - mean) - k @ kw
            both = _total(made, lambda k, w, x, beyond=beyond: np.vstack([k.T @ (r := beyond(k, w)), r.T @ r]), (m + width, width))
            kr, rr = both[:m], both[m:]
            h[step] = kw = kw + kr
            widths.append(width)
            left = rr - kr.T @ kr
            values, vectors = np.linalg.eigh((left + left.T) / 2)
            keep = values > 1e-24 * (np.trace(kw.T @ kw) + np.trace(rr))
            last = (vectors[:, keep] * np.sqrt(values[keep])).T
            if step + 1 == steps or not keep.any():
                break
            turn = vectors[:, keep] / np.sqrt(values[keep])
            drop(held)  # the product was written from it
            now, held, width = based(made, mean, turn, True, kw), made, int(keep.sum())
        m = sum(widths)
        small = np.zeros((m, m))
        at = 0
        for step, w in enumerate(widths):
            rows_ = h[step]
            small[: len(rows_), at : at + w] = rows_
            small[at : at + w, : len(rows_)] = rows_.T
            at += w
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        residual = np.sqrt(((last @ vectors[m - widths[-1] :, :dims]) ** 2).sum(0)) if last.size else np.zeros(dims)
        best = cut_lineage(based(now, np.zeros(m), vectors[:, : min(m, dims + 6)], False))
        drop(made, held, first)
        first = orthonormal(best)
        drop(best)
        if residual.max(initial=0.0) <= tol * max(abs(values[0]), 1e-300):
            break
    else:
        raise ValueError(f"no end after {cycles} cycles")
    flat = _entries(first, dims)
    ends = flat.agg(*[F.max_by(F.col("v")[e], F.struct(F.abs(F.col("v")[e]), -F.col("id"))).alias(f"s{e}") for e in range(dims)]).first()
    signs = [-1.0 if (ends[e] or 0) < 0 else 1.0 for e in range(dims)]
    return [float(v) for v in values[:dims]], flat.select("id", F.array(*[F.col("v")[e] * F.lit(signs[e]) for e in range(dims)]).alias("v"))


def _entries(state: DataFrame, dims: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                ids, k = _columns(batch, r, "id", "k")
                k = k.reshape(len(ids), -1)[:, :dims]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.FixedSizeListArray.from_arrays(pa.array(k.ravel()), dims).cast(_LIST)], names=["id", "v"])

    return state.mapInArrow(run, "id long, v array<double>")


def scaled(points: DataFrame, dims: int = 2, **options) -> DataFrame:
    """``id, y``: classical scaling, unit vectors times the roots of their eigenvalues; an axis without variance is 0."""
    values, v = leading_pairs(points, dims, **options)
    return v.select("id", F.array(*[F.col("v")[e] * F.lit(max(x, 0.0) ** 0.5) for e, x in enumerate(values)]).alias("y"))
