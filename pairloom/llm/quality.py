"""Quality by a regularised quadratic discriminant over document statistics.

Each document gives a fixed vector of statistics of its whole text, transformed towards normal shape. Each class has a
mean and a covariance, shrunk towards the pooled covariance and towards its diagonal. A score is the difference of the
classes' log densities: Mahalanobis distances by Cholesky factors that are computed once and go along with the tasks.
The differences of the training rows, whose spread shows how far the normal form overstates its certainty, scale the
score to a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, held_out, staged

STATISTICS = [
    "log_bytes", "log_words", "word_length", "upper", "digit", "punctuation", "symbol", "space", "newline", "non_ascii",
    "distinct_words", "top_word", "repeated_pairs", "capital_words", "symbol_words", "log_longest_word", "line_words", "distinct_lines",
]

#: Class of each byte: 0 other, 1 upper, 2 lower, 3 digit, 4 sentence punctuation, 5 symbol, 6 blank, 7 line end, 8 not ASCII.
_KIND = np.zeros(256, np.uint8)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3), (b".,;:'\"?-()", 4), (b"!#$%&*+/<=>@[\\]^_`{|}~", 5), (b" \t\r\x0b\x0c", 6), (b"\n", 7)):
    _KIND[list(_chars)] = _k
_KIND[128:] = 8


def _logit(share: float, n: int) -> float:
    """Log odds of a share of ``n`` things, moved off 0 and 1 by half a thing."""
    p = (share * n + 0.5) / (n + 1.0)
    return float(np.log(p / (1.0 - p)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text; a null text counts as empty, and an empty one has a vector like any."""
    raw = (text or "").encode()
    n = len(raw)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=9) if n else np.zeros(9, np.int64)
    words = raw.split()
    m = len(words)
    lines = [x for x in raw.split(b"\n") if x]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    share = lambda k: _logit(kinds[k] / max(n, 1), n)
    capital = sum(w.isupper() for w in words)
    ended = sum(_KIND[w[-1]] == 5 for w in words)
    return [
        float(np.log1p(n)), float(np.log1p(m)), float(np.log1p(sum(map(len, words)) / max(m, 1))), share(1), share(3), share(4), share(5), share(6), share(7), share(8),
        _logit(len(counts) / max(m, 1), m), _logit(max(counts.values(), default=0) / max(m, 1), m), _logit(repeats / max(m - 1, 1), max(m - 1, 0)),
        _logit(capital / max(m, 1), m), _logit(ended / max(m, 1), m), float(np.log1p(max(map(len, words), default=0))),
        float(np.log1p(m / max(len(lines), 1))), _logit(len(set(lines)) / max(len(lines), 1), len(lines)),
    ]


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the statistics of each whole text as ``x array<double>``; no shuffle."""
    bound_batches(docs.sparkSession)
    fields = docs.select(*keep).schema.fields
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "x array<double>"])
    width = len(fields)

    def run(batches):
        for b in batches:
            rows = np.array([statistics(t.as_py()) for t in b.column(width)], np.float64).reshape(-1)
            ends = np.arange(0, len(rows) + 1, len(STATISTICS), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.ListArray.from_arrays(ends, pa.array(rows))], names=[f"c{i}" for i in range(width)] + ["x"])

    return docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t")).mapInArrow(run, schema).toDF(*keep, "x")


@dataclass
class Model:
    """Per class: log prior, mean, inverse of the Cholesky factor and half its log determinant; then scale and shift."""

    prior: np.ndarray
    mean: np.ndarray
    inverse: np.ndarray
    half_log_det: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, priors included."""
        log = []
        for k in (0, 1):
            z = (x - self.mean[k]) @ self.inverse[k].T
            log.append(self.prior[k] - self.half_log_det[k] - 0.5 * np.einsum("ij,ij->i", z, z))
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        # The difference grows with the square of the distance; its signed root keeps the order and tames the tails.
        d = self.difference(x)
        t = np.clip(self.scale * np.sign(d) * np.sqrt(np.abs(d)) + self.shift, -40, 40)
        return 1.0 / (1.0 + np.exp(-t))


def _moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products by label; each task sends one row a label."""
    d = len(STATISTICS)

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            label = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(-1, d)
            one = np.hstack([np.ones((len(x), 1)), x])
            for k in np.unique(label):
                part = one[label == k]
                held[int(k)] = held.get(int(k), 0) + part.T @ part
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([m.ravel().tolist() for m in held.values()], pa.list_(pa.float64()))], names=["label", "m"])

    parts = rows.mapInArrow(run, "label int, m array<double>").select("label", F.posexplode("m").alias("i", "v"))
    sums: dict[int, np.ndarray] = {}
    for r in parts.groupBy("label", "i").agg(F.sum("v").alias("v")).collect():  # two classes of (d + 1) squared numbers
        sums.setdefault(r["label"], np.zeros((d + 1) ** 2))[r["i"]] = r["v"]
    return {k: (m.reshape(d + 1, d + 1)[0, 0], m.reshape(d + 1, d + 1)[0, 1:], m.reshape(d + 1, d + 1)[1:, 1:]) for k, m in sums.items()}


#: Width of the cells of signed roots that calibration counts; and the root beyond which all are alike.
CELL, FARTHEST = 1 / 64, 1000.0


def calibration(rows: DataFrame, model: Model) -> DataFrame:
    """``label, cell, n``: training rows by label and by the signed root of their log-density difference, in cells of ``CELL``.

    All rows count; there are at most 2 * 2 * FARTHEST / CELL cells, whatever the number of rows.
    """
    d = len(STATISTICS)

    def run(batches):
        held: dict[tuple[int, int], int] = {}
        for b in batches:
            diff = model.difference(b.column(1).flatten().to_numpy().reshape(-1, d))
            t = np.clip(np.sign(diff) * np.sqrt(np.abs(diff)), -FARTHEST, FARTHEST)
            both, n = np.unique(np.stack([b.column(0).to_numpy().astype(np.int64), np.rint(t / CELL).astype(np.int64)]), axis=1, return_counts=True)
            for label, cell, c in zip(*both.tolist(), n.tolist()):
                held[label, cell] = held.get((label, cell), 0) + c
        if held:
            label, cell = zip(*held)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(cell, pa.int32()), pa.array(list(held.values()), pa.int64())], names=["label", "cell", "n"])

    return rows.mapInArrow(run, "label int, cell int, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))


def logistic(t: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through ``n`` rows each at (t, y), by Newton's steps, slightly ridged."""
    w = np.zeros(2)
    design = np.column_stack([t, np.ones_like(t)])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -40, 40)))
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (n * (y - p)) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(rows: DataFrame, pooled: float = 0.1, diagonal: float = 0.05) -> Model:
    """The model of training rows ``label, x``. Moments and the probability's scale cover all rows.

    ``pooled`` and ``diagonal`` are the shares of the pooled covariance and of the diagonal in a class's covariance.
    Without rows of a class, its density is the standard normal one and its prior that of half a row.
    """
    d = len(STATISTICS)
    rows = rows.select(F.col("label").cast("int").alias("label"), "x").filter(F.col("label").isin(0, 1))
    moments = _moments(rows)
    total = sum(m[0] for m in moments.values())
    n = np.array([moments[k][0] if k in moments else 0.0 for k in (0, 1)])
    mean = np.array([moments[k][1] / n[k] if n[k] else np.zeros(d) for k in (0, 1)])
    cov = [moments[k][2] / n[k] - np.outer(mean[k], mean[k]) if n[k] else np.eye(d) for k in (0, 1)]
    common = (n[0] * cov[0] + n[1] * cov[1]) / total if total else np.eye(d)
    inverse, half_log_det = [], []
    for k in (0, 1):
        share = min(1.0, pooled + d / max(n[k], 1.0))  # few rows lean on the pooled covariance
        c = (1 - share) * cov[k] + share * common
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-3 * np.eye(d)
        factor = np.linalg.cholesky(c)
        inverse.append(np.linalg.inv(factor))
        half_log_det.append(np.log(np.diag(factor)).sum())
    model = Model(np.log((n + 0.5) / (total + 1.0)), mean, np.array(inverse), np.array(half_log_det))
    if total and n.min():
        cells = calibration(rows, model).toPandas()  # bounded by the number of cells
        scale, shift = logistic(cells["cell"].to_numpy() * CELL, cells["label"].to_numpy(np.float64), cells["n"].to_numpy(np.float64))
        if scale > 0:
            model.scale, model.shift = scale, shift
    return model


def score(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``x`` replaced by ``score``, the probability of class 1."""
    keep = [c for c in rows.columns if c != "x"]
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep), "score double"])

    def run(batches):
        for b in batches:
            x = b.column(len(keep)).flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(model.score(x))], names=[*keep, "score"])

    return rows.select(*keep, "x").mapInArrow(run, schema)


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; learns from labelled rows that aren't held out.

    Null texts count as empty, and empty ones have a score like any. A document whose label is repeated counts once, one
    with both labels teaches nothing, and null ids and labels don't either. Rows with equal texts get equal scores; an
    empty table of documents or labels gives no rows, or scores of a model without rows.
    """
    rows = staged(with_statistics(docs.select("doc_id", "text"), ["doc_id"]), "statistics").withColumn("held_out", held_out())
    known = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("labelled")).agg(F.min("quality").alias("label"), F.max("quality").alias("top"))
    known = known.filter("label = top").drop("top")
    train = rows.filter(~F.col("held_out")).join(known, F.col("doc_id") == F.col("labelled")).select("label", "x")
    out = score(rows.select("doc_id", "held_out", "x"), fit(train))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
