"""All pairs of points by tiles: what is asked of the pairs is added up where their distances are made.

Points are dealt to blocks, whose number is bounded until blocks hold ``WIDEST`` points; a tile is a pair of blocks. So what is
shuffled is every point once a block, in proportion to the points, and a task holds two blocks. Within a tile the distances come in parts
that stay in a core's cache; no pair becomes a row unless it is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points of a block at least, blocks at most, and points of a block from which on there are more blocks.
BLOCK, BLOCKS, WIDEST = 512, 32, 1 << 15
#: Blocks at most where a tile's work is worth more than its points' way there: points are sent about so many times.
FEW = 12
#: Rows and columns of a part of a tile.
HIGH, WIDE = 128, 1024


def blocks_of(n: int, block: int = BLOCK, *, most: int = BLOCKS) -> int:
    return max(1, min(-(-n // block), most), -(-n // WIDEST))


def dealt_alike(points: DataFrame, spaces: list[str], block: int, most: int) -> DataFrame:
    """``dealt`` within labels: only blocks of one label meet; points without a label are left out."""
    n = points.filter("label IS NOT NULL").groupBy(F.col("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    n = n.select("label", F.greatest(F.least(F.ceil(F.col("n") / block), F.lit(most)), F.ceil(F.col("n") / WIDEST)).cast("int").alias("k"))
    parts = max(1, min(n.agg(F.sum(F.col("k") * (F.col("k") + 1) / 2)).first()[0] or 1, 4096))
    rows = points.select("id", F.col("label").cast("long").alias("label"), *spaces).join(n, "label").withColumn("b", F.pmod(F.xxhash64("id"), "k").cast("int"))
    packed = rows.groupBy(F.col("label").alias("g"), "b").agg(F.max("k").alias("k"), F.sort_array(F.collect_list(F.struct("id", "label", *spaces))).alias("r"))
    flat = packed.select("g", "k", "b", F.col("r.id").alias("id"), F.col("r.label").alias("label"), *[F.flatten(F.col(f"r.{c}")).alias(c) for c in spaces])
    side = lambda e, *more: flat.select("g", F.col("b").alias(f"b{e}"), *more, *[F.col(c).alias(f"{c}{e}") for c in ("id", "label", *spaces)])
    left = side(1, F.explode(F.sequence("b", F.col("k") - 1)).alias("b2"))
    right = side(2, F.explode(F.sequence(F.lit(0), F.col("b"))).alias("b1"))
    return left.repartition(int(parts), "g", "b1", "b2").join(right.repartition(int(parts), "g", "b1", "b2").hint("shuffle_hash"), ["g", "b1", "b2"]).drop("g")


def dealt(points: DataFrame, spaces: list[str], block: int = BLOCK, ordered: bool = False, *, most: int = BLOCKS) -> DataFrame:
    """``b1, b2`` and the ids, labels and coordinates of both blocks, a row a tile: ``b1 <= b2`` or, if ``ordered``, any two."""
    blocks = blocks_of(points.count(), block, most=most)
    rows = points.select("id", F.col("label").cast("long").alias("label"), *spaces).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    packed = rows.groupBy("b").agg(F.sort_array(F.collect_list(F.struct("id", "label", *spaces))).alias("r"))
    flat = packed.select("b", F.col("r.id").alias("id"), F.col("r.label").alias("label"), *[F.flatten(F.col(f"r.{c}")).alias(c) for c in spaces])
    side = lambda k: flat.select(F.col("b").alias(f"b{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("id", "label", *spaces)])
    tiles = blocks * blocks if ordered else blocks * (blocks + 1) // 2
    left = side(1).withColumn("b2", F.explode(F.sequence(F.lit(0) if ordered else F.col("b1"), F.lit(blocks - 1))))
    right = side(2).withColumn("b1", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1) if ordered else F.col("b2"))))
    parts = min(tiles, 4096)
    return left.repartition(parts, "b1", "b2").join(right.repartition(parts, "b1", "b2").hint("shuffle_hash"), ["b1", "b2"])


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances by differences, dimension by dimension: the same to the last bit wherever they are made."""
    step, held = np.empty((len(a), len(b))), np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        np.subtract(a[:, k : k + 1], b[None, :, k], out=step)
        np.multiply(step, step, out=step)
        np.add(held, step, out=held)
    return np.sqrt(held, out=held)


def products(a: np.ndarray, b: np.ndarray, close: float = 1e-3) -> np.ndarray:
    """Distances by a matrix product; those far below the points' norms, where that loses digits, by differences."""
    if a.shape[1] < 8:
        return differences(a, b)
    middle, given = a.mean(0), (a, b)
    a, b = a - middle, b - middle
    sa, sb = (a * a).sum(1), (b * b).sum(1)
    out = np.concatenate([a, sa[:, None], np.ones((len(a), 1))], 1) @ np.concatenate([-2.0 * b, np.ones((len(b), 1)), sb[:, None]], 1).T
    least = close * (sa.max(initial=0.0) + sb.max(initial=0.0))
    i, j = np.nonzero(out < least) if out.min(initial=np.inf) < least else ((), ())
    for s in range(0, len(i), 1 << 16):
        p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        out[p, q] = ((given[0][p] - given[1][q]) ** 2).sum(1)
    return np.sqrt(out, out=out)


def closest(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, high: int = 256, wide: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``i, j, d`` of the k nearest of each ``a`` among ``b``, itself not among them; ties by id."""
    for r in range(0, len(a), high):
        n = len(a[r : r + high])
        i, at, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        edge = np.full(n, np.inf)
        for c in range(0, len(b), wide):
            new = differences(x[r : r + high], y[c : c + wide])
            new[a[r : r + high, None] == b[None, c : c + wide]] = np.inf
            if not c and new.shape[1] > k:
                edge = np.partition(new, k - 1, axis=1)[:, k - 1]
            p, q = np.nonzero(new <= edge[:, None])  # ties at the edge stay until ids decide
            if not len(p):
                continue
            i, at, d = np.concatenate([i, p]), np.concatenate([at, b[c + q]]), np.concatenate([d, new[p, q]])
            order = np.lexsort((at, d, i))
            i, at, d = i[order], at[order], d[order]
            begin = np.searchsorted(i, np.arange(n))
            kept = np.arange(len(i)) - begin[i] < k
            i, at, d = i[kept], at[kept], d[kept]
            last = np.searchsorted(i, np.arange(n), side="right") - 1
            full = np.bincount(i, minlength=n) >= k
            edge = np.where(full, d[np.maximum(last, 0)], np.inf)
        known = np.isfinite(d)
        yield a[r : r + high][i[known]], at[known], d[known]


@dataclass
class Part:
    """The distances of some rows to some columns, by space; ``keep`` marks each pair once where a block meets itself."""

    rows: slice
    columns: slice
    d: list[np.ndarray]
    keep: np.ndarray | None

    def pairs(self, v: np.ndarray) -> np.ndarray:
        return v.ravel() if self.keep is None else v[self.keep]

    def only(self, v: np.ndarray) -> np.ndarray:
        return v if self.keep is None else np.where(self.keep, v, 0.0)


class Tile:
    """One pair of blocks: ``ids``, ``labels`` (``none`` marks those without) and coordinates ``x`` by space, for both."""

    def __init__(self, row: pa.RecordBatch, spaces: list[str], ordered: bool):
        at = lambda c: row.column(c).flatten()
        self.same = not ordered and row.column("b1")[0] == row.column("b2")[0]
        self.ids = [at(f"id{e}").to_numpy() for e in (1, 2)]
        self.none = [np.asarray(at(f"label{e}").is_null()) for e in (1, 2)]
        self.labels = [np.asarray(at(f"label{e}").fill_null(0)) for e in (1, 2)]
        self.x = [[at(f"{c}{e}").to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(i), -1) for e, i in ((1, self.ids[0]), (2, self.ids[1]))] for c in spaces]

    def parts(self, distances: Callable = products, high: int = HIGH, wide: int = WIDE) -> Iterator[Part]:
        n, m = (len(i) for i in self.ids)
        for r in range(0, n, high):
            for c in range(r if self.same else 0, m, wide):
                rows, columns = slice(r, min(n, r + high)), slice(c, min(m, c + wide))
                keep = np.triu(np.ones((rows.stop - r, columns.stop - c), bool), 1) if self.same and r == c else None
                yield Part(rows, columns, [distances(x[0][rows], x[1][columns]) for x in self.x], keep)


def over(points: DataFrame, work: Callable[[Tile], Iterator[pa.RecordBatch]], schema: str, spaces: tuple[str, ...] = ("x", "y"), block: int = BLOCK, ordered: bool = False, *, most: int = BLOCKS, alike: bool = False) -> DataFrame:
    """What ``work`` gives of every tile, of at most ``most`` blocks until these are full; with ``alike`` of tiles within labels."""
    names = list(spaces)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield from work(Tile(batch.slice(k, 1), names, ordered))

    met = dealt_alike(points, names, block, min(most, FEW)) if alike else dealt(points, names, block, ordered, most=most)
    return met.mapInArrow(run, schema)


def _merged(parts: np.ndarray, size: int, together: list[tuple[int, int]]) -> np.ndarray:
    """Rows of count; then means, second, third and fourth central sums, smallest, largest of ``size`` terms; then mixed central sums."""
    n = parts[:, :1]
    of = lambda k: parts[:, 1 + k * size : 1 + (k + 1) * size]
    total = n.sum()
    mean = (n * of(0)).sum(0) / total
    d = of(0) - mean
    m2 = (of(1) + n * d**2).sum(0)
    m3 = (of(2) + 3 * d * of(1) + n * d**3).sum(0)
    m4 = (of(3) + 4 * d * of(2) + 6 * d**2 * of(1) + n * d**4).sum(0)
    mixed = [(parts[:, 1 + 6 * size + k] + n[:, 0] * d[:, a] * d[:, b]).sum() for k, (a, b) in enumerate(together)]
    return np.concatenate([[total], mean, m2, m3, m4, of(4).min(0), of(5).max(0), mixed])


def totals(points: DataFrame, terms: Callable[..., dict[str, np.ndarray]], names: list[str], orders: dict[str, int] | None = None, together: tuple[tuple[str, str], ...] = (), spaces: tuple[str, ...] = ("x", "y"), ends: tuple[str, ...] = ("hi",)) -> DataFrame:
    """One row with ``n`` and, for each of ``names``, the sum ``c`` over all pairs; ``c_low`` and ``c_high`` for those in ``ends``; for those with
    an order of 2 or 4 also the mean ``c_mean`` and the central sums ``c_m2`` to ``c_m4``, and ``a_b`` for names taken together. NULL without a pair.

    ``terms`` gives arrays by name from a part's distances, an array a space. Parts are merged by their means, so nothing
    cancels, and a tile gives one row.
    """
    orders = orders or {}
    size = len(names)
    mixed = [(names.index(a), names.index(b)) for a, b in together]

    def one(part: Part) -> np.ndarray | None:
        t = terms(*[part.pairs(d) for d in part.d])
        n = len(t[names[0]])
        if not n:
            return None
        out = np.zeros(1 + 6 * size + len(mixed))
        out[0] = n
        off = {}
        for k, c in enumerate(names):
            v, order = t[c], max([orders.get(c, 1)] + [2 for pair in together if c in pair])
            mean = v.mean()
            out[1 + k] = mean
            if c in ends:
                out[1 + 4 * size + k], out[1 + 5 * size + k] = v.min(), v.max()
            if order > 1:
                off[c] = d = v - mean
                square = d * d
                out[1 + size + k] = square.sum()
                if order > 2:
                    out[1 + 2 * size + k], out[1 + 3 * size + k] = (square * d).sum(), (square * square).sum()
        for k, (a, b) in enumerate(together):
            out[1 + 6 * size + k] = (off[a] * off[b]).sum()
        return out

    def work(tile: Tile):
        found = [p for p in map(one, tile.parts()) if p is not None]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([_merged(np.stack(found), size, mixed)], pa.list_(pa.float64()))], names=["t"])

    rows = [r[0] for r in over(points, work, "t array<double>", spaces).collect()]  # a few sums a tile
    t = _merged(np.array(rows), size, mixed).tolist() if rows else None
    cells: dict[str, float | None] = {"n": int(t[0]) if t else 0}
    for k, c in enumerate(names):
        at = lambda e: t[1 + e * size + k] if t else None  # noqa: B023, E731
        cells |= {c: t[0] * at(0) if t else None}
        if c in ends:
            cells |= {f"{c}_low": at(4), f"{c}_high": at(5)}
        if orders.get(c, 1) > 1 or any(c in pair for pair in together):
            cells |= {f"{c}_mean": at(0), f"{c}_m2": at(1), f"{c}_m3": at(2), f"{c}_m4": at(3)}
    cells |= {f"{a}_{b}": t[1 + 6 * size + k] if t else None for k, (a, b) in enumerate(together)}
    return points.sparkSession.createDataFrame([tuple(cells.values())], ", ".join(f"{c} {'long' if c == 'n' else 'double'}" for c in cells))


def sums_by_point(points: DataFrame, terms: Callable[[Tile, Part], list[np.ndarray]], names: list[str], signs: tuple[int, ...] | None = None) -> DataFrame:
    """``i`` and for each name the sum over a point's partners, and the number ``n`` of these.

    ``terms`` gives a rows x columns array a name; ``signs`` says whether a pair's term is the same (1) or the opposite (-1) seen from
    its other end. A tile gives a row for each of its points.
    """
    signs = signs or (1,) * len(names)

    def work(tile: Tile):
        total = [np.zeros((len(i), len(names) + 1)) for i in tile.ids]
        for part in tile.parts():
            ones = [np.ones(part.d[0].shape)]
            for k, (v, sign) in enumerate(zip(ones + terms(tile, part), (1, *signs))):
                v = part.only(v)
                total[0][part.rows, k] += v.sum(1)
                total[1][part.columns, k] += sign * v.sum(0)
        if tile.same:
            total = [total[0] + total[1]]
        for ids, t in zip(tile.ids, total):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(t[:, 0].astype(np.int64)), *[pa.array(t[:, 1 + k]) for k in range(len(names))]], names=["i", "n", *names])

    rows = over(points, work, "i long, n long, " + ", ".join(f"{c} double" for c in names))
    return rows.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).filter("n > 0")
