"""Bootstrap in one pass: every row weighs a Poisson number in every draw, and draws are sums that tasks add up.

A statistic is given by its mergeable part, columns that are summed, and by an expression over the sums. A task holds the
sums of its draws alone, so neither rows nor memory grow with rows times draws; what is shuffled is a row a task and draw.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import ratio

#: Weights come from numbers below this prime, twice squared, of which SQL can say the same in 64-bit integers.
PRIME = 2**31 - 1
FACTOR, STEP = 48271, 69621
#: A number weighs as many times as it reaches one of these: the distribution of a Poisson number of mean 1.
THRESHOLDS = [math.floor(PRIME * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(11)]
#: Bytes of sums that a task gathers before it hands them on, if there are many groups.
HELD = 32 << 20


def row_number_of(key: Column | str) -> Column:
    """28 bits of a key's text; a null key is an empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 7), 16, 10).cast("long")


def weights(h: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """Rows times draws: the Poisson number of each."""
    x = (h[:, None] * FACTOR + draws[None] * STEP + seed) % PRIME
    for add in (draws, seed):
        x = (x * x + add) % PRIME
    return np.searchsorted(THRESHOLDS, x, side="right")


def weight_sql(h: str, draw: str, seed: int) -> str:
    """``weights`` as SQL, for a check by another engine."""
    x = f"(({h} * {FACTOR} + {draw} * {STEP} + {seed}) % {PRIME})"
    for add in (draw, str(seed)):
        x = f"(({x} * {x} + {add}) % {PRIME})"
    return "list_sum([(" + x + f" >= t)::INT FOR t IN {THRESHOLDS}])"


def drawn_sums(df: DataFrame, key: Column | str, terms: dict[str, Column], draws: int, seed: int, group: Column | None = None) -> DataFrame:
    """``group, draw`` and every term's weighted sum. Rows of equal keys are taken together: a key is what is resampled.

    A row without one of the terms is left out; draws of a group that take no row at all have no row.
    """
    if draws < 1 or not 0 <= seed < PRIME:
        raise ValueError("at least one draw, and a seed below 2^31 - 1")
    names, numbers = list(terms), np.arange(draws, dtype=np.int64)
    whole = df.select((group if group is not None else F.lit("")).cast("string").alias("group"), row_number_of(key).alias("h"), *[t.cast("double").alias(n) for n, t in terms.items()])
    whole = whole.dropna("any", subset=names)
    schema = "group string, draw long, w double" + "".join(f", `{n}` double" for n in names)

    def told(held: dict) -> pa.RecordBatch:
        table = np.concatenate(list(held.values()))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.array(list(held), dtype=object), draws), pa.string()), pa.array(np.tile(numbers, len(held))), *[pa.array(c) for c in table.T]], names=["group", "draw", "w", *names]
        )

    def run(batches):
        held: dict = {}
        for b in batches:
            groups, codes = np.unique(np.array(["\0" if g is None else "=" + g for g in b.column(0).to_pylist()], dtype=object), return_inverse=True)
            h = b.column(1).to_numpy()
            x = np.stack([np.ones(len(b)), *[c.to_numpy(zero_copy_only=False) for c in b.columns[2:]]], 1) if len(b) else np.zeros((0, 1 + len(names)))
            order = np.argsort(codes, kind="stable")
            for g, at in zip(groups, np.split(order, np.cumsum(np.bincount(codes, minlength=len(groups)))[:-1])):
                name = None if g == "\0" else g[1:]
                sums = held.setdefault(name, np.zeros((draws, x.shape[1])))
                for low in range(0, len(at), 1024):
                    part = at[low : low + 1024]
                    for d in range(0, draws, 1024):
                        sums[d : d + 1024] += weights(h[part], numbers[d : d + 1024], seed).T.astype(float) @ x[part]
                if len(held) * draws * x.shape[1] * 8 > HELD:
                    yield told(held)
                    held = {}
        if held:
            yield told(held)

    return whole.mapInArrow(run, schema).groupBy("group", "draw").agg(F.sum("w").alias("w"), *[F.sum(n).alias(n) for n in names]).filter("w > 0")


def interval(df: DataFrame, key: Column | str, terms: dict[str, Column], statistic: Column, draws: int, seed: int, level: float = 0.95, group: Column | None = None) -> DataFrame:
    """``group, value, low, high, draws``: a statistic of sums over all rows, and its percentile interval over the draws that have a value.

    A group with fewer than two such draws has no interval. Without rows there is no row.
    """
    tail = (1 - level) / 2
    whole = df.select((group if group is not None else F.lit("")).cast("string").alias("group"), *[t.cast("double").alias(n) for n, t in terms.items()]).dropna("any", subset=list(terms))
    at = whole.groupBy("group").agg(*[F.sum(n).alias(n) for n in terms]).select("group", statistic.alias("value"))
    s = drawn_sums(df, key, terms, draws, seed, group).select("group", statistic.alias("s"))
    some = F.count("s") >= 2
    over = s.groupBy("group").agg(F.when(some, F.percentile("s", tail)).alias("low"), F.when(some, F.percentile("s", 1 - tail)).alias("high"), F.count("s").alias("draws"))
    return at.join(over, at["group"].eqNullSafe(over["group"]), "left").select(at["group"], "value", "low", "high", F.coalesce("draws", F.lit(0)).alias("draws"))


def mean_of(x: str) -> tuple[dict[str, Column], Column]:
    return {"n": F.when(F.col(x).isNotNull(), 1.0), "s": F.col(x)}, ratio(F.col("s"), F.col("n"))


def slope_of(x: str, y: str) -> tuple[dict[str, Column], Column]:
    """Least squares of ``y`` on ``x``. Rows are told as moments, so values far from 0 should be centred before."""
    a, b = F.col(x), F.col(y)
    terms = {"n": F.when(a.isNotNull() & b.isNotNull(), 1.0), "sx": a, "sy": b, "xx": a * a, "xy": a * b}
    return terms, ratio(F.col("n") * F.col("xy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("xx") - F.col("sx") ** 2)


def correlation_of(x: str, y: str) -> tuple[dict[str, Column], Column]:
    """Pearson's correlation; centre values far from 0 before. Of ranks over all rows it is Spearman's with ranks kept."""
    terms, _ = slope_of(x, y)
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    spread = F.sqrt(F.greatest(F.lit(0.0), n * F.col("xx") - sx**2)) * F.sqrt(F.greatest(F.lit(0.0), n * F.col("yy") - sy**2))
    return {**terms, "yy": F.col(y) * F.col(y)}, ratio(n * F.col("xy") - sx * sy, spread)
