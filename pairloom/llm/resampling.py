"""Importance resampling towards a target corpus.

Runs of one to three words fall into hashed buckets. A bucket's gain compares how often the target and the whole corpus
use it; a document's weight adds up the gains of its runs, looked up in one array. Noise of the extreme-value law, drawn
from the id, turns the best scores into a draw without replacement in proportion to weights.

The draw is by merging: every task writes sorted runs of its eligible rows, cut where ranges of the order begin. A range's
pieces of all runs are merged by a tournament tree, ranges follow one another by their counts, and what comes after the
range in which the draw ends is never merged.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_staged, partitions_for, repeated, staged
from .lexical import word_lists

#: Rows of a sorted run, and rows that a range of the order should have.
RUN_ROWS, RANGE_ROWS = 100_000, 100_000

#: What is known of a row; two rows alike in all of it are interchangeable.
ENTRY = ["id", "n_words", "n_features", "weight", "score"]


def features(raw: bytes, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per part of a text: its words, and the buckets of all runs of one to three words that end in the part.

    A run's checksum goes on from that of the run without its last word, so nothing is joined.
    """
    one = two = None  # checksums of the runs of one and of two words that end where the last part ended
    for words in word_lists(raw):
        more = [b" " + w for w in words]
        ones = list(map(crc32, words))
        twos = list(map(crc32, more if one is not None else more[1:], ([one] if one is not None else []) + ones[:-1]))
        have = ([two] if two is not None else []) + twos[:-1]
        threes = list(map(crc32, more[len(more) - len(have) :], have))
        found = np.array(ones + twos + threes, np.int64)
        one, two = ones[-1], twos[-1] if twos else None
        yield len(words), found % buckets


def counts(docs: DataFrame, text_col: str = "text", buckets: int = 10_000) -> DataFrame:
    """``bucket, n`` over all texts: each task adds up its own, and gives each bucket once. Null texts have no features."""
    bound_batches(docs.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b.column(0):
                for _, found in features(t.as_py() or b"", buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    each = docs.select(F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", buckets: int = 10_000) -> np.ndarray:
    """The gain of every bucket, rounded down to thousandths; one array of ``buckets`` numbers, whatever the corpus."""
    both = []
    for df in (docs, target):
        held = np.zeros(buckets, np.int64)
        for bucket, n in counts(df, text_col, buckets).collect():  # at most one row a bucket
            held[bucket] = n
        both.append(held)
    (s, t), (all_s, all_t) = both, (int(both[0].sum()), int(both[1].sum()))
    gain = lambda a, b: math.floor(1000 * math.log(((b + 1) * (all_s + buckets)) / ((a + 1) * (all_t + buckets))))
    return np.array([gain(a, b) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def noise(id_col: Column, seed: int = 42) -> Column:
    """Thousandths of a draw from the extreme-value law, rounded down; a null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """``id, n_words, n_features, weight, score`` of every row; a text without words has no features and weight 0."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                n = size = weight = 0
                for words, found in features(t.as_py() or b"", len(gain)):
                    n, size, weight = n + words, size + len(found), weight + int(gain[found].sum())
                rows.append((n, size, weight))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")
    return found.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


class Tournament:
    """Merges sorted runs. ``tree[k + i]`` is run i, an inner place holds the winner of the two below it."""

    def __init__(self, runs: list[Iterator[tuple]], key: Callable[[tuple], tuple]):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.tree = [0] * self.k + list(range(self.k))
        for place in range(self.k - 1, 0, -1):
            self._play(place)

    def _play(self, place: int) -> None:
        a, b = self.tree[2 * place], self.tree[2 * place + 1]
        ahead = self.keys[b] is None or self.keys[a] is not None and self.keys[a] <= self.keys[b]
        self.tree[place] = a if ahead else b

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[best := self.tree[1 if self.k > 1 else -1]] is not None:
            entry = self.heads[best]
            self.heads[best] = next(self.runs[best], None)
            self.keys[best] = None if self.heads[best] is None else self.key(self.heads[best])
            place = (self.k + best) // 2
            while place:
                self._play(place)
                place //= 2
            yield entry

    def rest(self) -> Iterator[tuple]:
        """What hasn't been merged, in no order."""
        for head, run in zip(self.heads, self.runs):
            if head is not None:
                yield head
                yield from run


def _order(row: tuple) -> tuple:
    """Highest score first, then the smallest id, null ids last, then fewest features: rows alike in all are one entry."""
    i, n_words, n_features, weight, score = row[: len(ENTRY)]
    return -score, i is None, 0 if i is None else i, n_features, weight, n_words


def _starts(rows: DataFrame, drawn: int, total: int, range_rows: int, per_range: int = 16) -> list[tuple]:
    """Where the ranges of the order begin, but for the first. The last holds the rows below a score that more rows than
    are drawn reach; the others have about ``range_rows`` rows, by keys of rows that a hash of the row chose. Where they begin decides how work is
    dealt, and no result."""
    spare = 1.1
    while True:
        share = min(1.0, spare * drawn / total)
        level = rows.select(F.percentile_approx("score", F.lit(1 - share), F.lit(10_000))).first()[0]
        if share == 1.0 or rows.filter(F.col("score") >= level).count() >= drawn:
            break
        spare *= 2
    upper = rows.filter(F.col("score") >= level)
    chosen = upper.filter(F.pmod(F.xxhash64(*ENTRY), F.lit(range_rows)) < per_range).select(*ENTRY).distinct()
    keys = sorted(_order(tuple(r)) for r in chosen.collect())[per_range - 1 :: per_range]
    return [*keys, (1 - level,)]


def _dealt(starts: list[tuple]):
    """Adds each row's range."""

    def run(batches):
        for b in batches:
            parts = [bisect_right(starts, _order(r)) for r in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.int64())], names=[*ENTRY, "part"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of a task's rows, cut where ranges begin: a piece is one row, in which equal rows are counted."""

    def cut(held: list[tuple], kinds: list[pa.DataType]):
        held.sort(key=lambda r: (r[-1], *_order(r)))
        pieces: dict[int, list] = {}
        for r in held:
            mine = pieces.setdefault(r[-1], [])
            if mine and mine[-1][0] == r:
                mine[-1][1] += 1
            else:
                mine.append([r, 1])
        columns = [pa.array([[e[0][c] for e in piece] for piece in pieces.values()], pa.list_(t)) for c, t in enumerate(kinds)]
        times = pa.array([[e[1] for e in piece] for piece in pieces.values()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int64()), *columns, times], names=["part", *ENTRY, "n"])

    held: list[tuple] = []
    kinds: list[pa.DataType] = []
    for b in batches:
        kinds = [c.type for c in b.columns[:-1]]
        held += zip(*(c.to_pylist() for c in b.columns))
        if len(held) >= RUN_ROWS:
            yield cut(held, kinds)
            held = []
    if held:
        yield cut(held, kinds)


def _merge(before: dict[int, int], drawn: int):
    """Ranks of a range's entries from its pieces; after the last draw the rest of the pieces isn't merged any more."""

    def run(group: pa.Table) -> pa.Table:
        kind = group.schema.field("id").type.value_type
        pieces = [iter(list(zip(*(group.column(c)[i].as_py() for c in (*ENTRY, "n"))))) for i in range(len(group))]
        out, rank = [], before[group.column("part")[0].as_py()] + 1
        pieces = Tournament(pieces, _order)
        for entry in pieces:
            inside = min(entry[-1], drawn + 1 - rank)
            out.append((*entry[:-1], rank, inside))
            if entry[-1] > inside:
                out.append((*entry[:-1], None, entry[-1] - inside))
            rank += entry[-1]
            if rank > drawn:
                out += [(*e[:-1], None, e[-1]) for e in pieces.rest()]
                break
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [kind] + [pa.int64()] * 6)], names=[*ENTRY, "first", "n"])

    return run


def ranked(rows: DataFrame, drawn: int, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows``, a written table of ENTRY, with ``rank``: 1 .. ``drawn`` by descending score and ascending id, null ids
    last, and null for the others. Equal rows get neighbouring ranks. Ids are whole numbers or texts."""
    spark = rows.sparkSession
    if drawn < 1:
        return rows.select(*ENTRY).withColumn("rank", F.lit(None).cast("long"))
    starts = _starts(rows, drawn, rows.count(), range_rows)
    kind = rows.schema["id"].dataType.simpleString()
    dealt = staged(rows.select(*ENTRY).mapInArrow(_dealt(starts), f"id {kind}, n_words long, n_features long, weight long, score long, part long"), "resampling-dealt")
    before, last, at = {}, 0, 0
    for part, n in sorted(dealt.groupBy("part").count().collect()):  # a row a range
        if at < drawn:
            before[part], last = at, part
        at += n
    lists = ", ".join(f"{c} array<{kind if c == 'id' else 'long'}>" for c in [*ENTRY, "n"])
    runs = staged(dealt.filter(F.col("part") <= last).mapInArrow(_runs, f"part long, {lists}"), "resampling-runs")
    met = runs.repartition(partitions_for(spark, last + 1, 1), "part").groupBy("part").applyInArrow(_merge(before, drawn), f"id {kind}, n_words long, n_features long, weight long, score long, first long, n long")
    met = staged(met, "resampling-ranks")
    drop_staged(runs)
    taken = repeated(met.filter(F.col("first").isNotNull()), "n", "rank", F.col("first")).drop("first", "n")
    left = repeated(met.filter(F.col("first").isNull()), "n", "rank").drop("first", "n").union(dealt.filter(F.col("part") > last))
    return taken.unionByName(left.withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", buckets: int = 10_000, seed: int = 42) -> DataFrame:
    """Every row's ``id, n_words, n_features, weight, score, rank``; ranks go to the ``percent`` of those of ``least_words`` or more.

    Null and empty texts have no features and weight 0, and aren't eligible. Repeated rows are rows of their own with
    equal scores; equal scores go by ascending id, null ids last. Too few eligible rows, or none, draw nothing.
    """
    rows = staged(scored(docs, gains(docs, target, text_col, buckets), id_col, text_col, seed), "resampling-scores")
    eligible = rows.filter(F.col("n_words") >= least_words)
    drawn = percent * eligible.count() // 100
    others = rows.filter(F.col("n_words") < least_words).select(*ENTRY).withColumn("rank", F.lit(None).cast("long"))
    return ranked(eligible, drawn).unionByName(others)


def weighed(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document."""
    return resampled(docs, target).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
