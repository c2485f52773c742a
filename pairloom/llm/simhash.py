"""Near-duplicate groups by SimHash, searched through a hierarchical index in Gray order.

Two fingerprints of 64 bits that differ in at most three bits agree in one of four 16-bit quarters. So each distinct
fingerprint goes to four groups, by quarter and its value. In each group the fingerprints are sorted by Gray rank, which
puts codes with few differing bits side by side; runs of them become nodes that hold the bits all their members share,
and nodes of nodes those that the members' nodes share. A search adds up the differences in the bits of each node on the
way down and leaves a whole node as soon as they exceed three. Bits that an upper node holds aren't compared again.

Links are needed only for components: what a task finds is reduced to a forest before it leaves the task. Components are
found by alternating large-star and small-star steps over tables, written to the shared folder each round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bound_batches, drop_staged, free_name, partitions_for, small_side, staged

#: A-Z become a-z; space and the controls from tab to carriage return separate words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
FANOUT = 16


def fingerprint(raw: bytes, size: int = 3) -> int:
    """Bit by bit the majority of the shingles' XXH64 (seed 42); 0 without words; fewer words are one shingle."""
    words = raw.translate(FOLD).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        bits = np.unpackbits(np.array(hashes[i : i + 65536], np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, name: str = "fp") -> DataFrame:
    """``docs`` (or its columns ``keep``) with the fingerprint as a signed long; null texts have no words; no shuffle."""
    bound_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    name = free_name(docs.select(*keep), name)
    fields = docs.select(*keep).schema.fields
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), "fp long"])
    width = len(fields)

    def run(batches):
        for b in batches:
            found = np.array([fingerprint((x.as_py() or "").encode()) for x in b.column(width)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(found)], names=[f"c{i}" for i in range(width)] + ["fp"])

    out = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t")).mapInArrow(run, schema)
    return out.toDF(*keep, name)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order: its prefix parities."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Nodes over codes sorted by (group, Gray rank). A node holds what its members share and its parent doesn't."""

    def __init__(self, groups: np.ndarray, codes: np.ndarray, fanout: int = FANOUT):
        order = np.lexsort((gray_rank(codes), groups))
        self.order, self.codes, groups = order, codes[order], groups[order]
        value, mask = self.codes, np.full(len(codes), ~np.uint64(0))
        self.levels = []  # from the leaves: (value, mask of bits not held above, first child, children)
        owner = groups
        while True:
            new = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            size = np.diff(np.concatenate([first, [len(owner)]]))
            inside = np.arange(len(owner)) - np.repeat(first, size)
            cut = np.flatnonzero(inside % fanout == 0)  # parents never span two groups
            up_value, up_mask = value[cut] if len(cut) else value[:0], None
            same = np.bitwise_and.reduceat(mask, cut) if len(cut) else mask[:0]
            differ = np.bitwise_or.reduceat(value ^ np.repeat(up_value, np.diff(np.concatenate([cut, [len(value)]]))), cut) if len(cut) else same
            up_mask = same & ~differ
            span = np.diff(np.concatenate([cut, [len(value)]]))
            self.levels.append((value, mask & ~np.repeat(up_mask, span), cut, span))
            value, mask, owner = up_value, up_mask, owner[cut]
            if len(first) == len(cut):
                break
        self.root_value, self.root_mask, self.root_of = value, mask, owner
        self.group_of = groups

    def pairs(self, most: int = 3, at_once: int = 1 << 18):
        """Yields arrays (query, match) of places with query > match whose codes differ in at most ``most`` bits."""
        root = np.searchsorted(self.root_of, self.group_of)
        for begin in range(0, len(self.codes), at_once):
            q = np.arange(begin, min(begin + at_once, len(self.codes)))
            stack = [(len(self.levels) - 1, q, root[q], np.bitwise_count((self.codes[q] ^ self.root_value[root[q]]) & self.root_mask[root[q]]).astype(np.int64))]
            while stack:
                level, q, node, acc = stack.pop()
                ok = acc <= most
                q, node, acc = q[ok], node[ok], acc[ok]
                if not len(q):
                    continue
                if level < 0:
                    keep = q > node
                    yield q[keep], node[keep]
                    continue
                value, mask, first, span = self.levels[level]
                n = span[node]
                if len(q) > 1 and int(n.sum()) > 4 * at_once:
                    half = len(q) // 2
                    stack += [(level, q[:half], node[:half], acc[:half]), (level, q[half:], node[half:], acc[half:])]
                    continue
                child = np.repeat(first[node], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                qs = np.repeat(q, n)
                stack.append((level - 1, qs, child, np.repeat(acc, n) + np.bitwise_count((self.codes[qs] ^ value[child]) & mask[child]).astype(np.int64)))


class Forest:
    """Union-find over places, fed with arrays of links; the root of a tree is its smallest place."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            open_ = low < high
            a, b, low, high = a[open_], b[open_], low[open_], high[open_]
            np.minimum.at(self.up, high, low)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                self.up[x] = r
                return r
            r = s


#: Codes that one group should hold, and that one task should get.
GROUP_CODES, TASK_CODES = 20_000, 500_000


def dealt(codes: DataFrame, bits: int = 3, most: int = GROUP_CODES) -> DataFrame:
    """``fp, k``: each code once for each of its ``bits + 1`` parts, under a key that codes with an equal part share.

    A group of more than ``most`` codes is dealt again: what its codes don't share by the key is cut into ``bits + 1``
    parts once more, one of which two codes of at most ``bits`` bits share as well. So groups stay small where many codes
    agree in a part, and no link is lost.
    """
    parts = bits + 1
    width = 64 // parts
    low = F.lit((1 << width) - 1)
    number = F.array(*[F.lit(i) for i in range(parts)])
    once = codes.select("fp", F.explode(number).alias("i"))
    right = lambda c, n: F.call_function("shiftrightunsigned", F.col(c), n)
    left = lambda c, n: F.call_function("shiftleft", c, n)
    once = once.withColumn("v", right("fp", F.col("i") * width).bitwiseAND(low)).withColumn("k", F.col("v") + F.col("i").cast("long") * (1 << width))
    heavy = staged(once.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("k", F.lit(True).alias("heavy")), "heavy-groups")
    if not heavy.limit(1).count():
        drop_staged(heavy)
        return once.select("fp", "k")
    marked = once.join(small_side(heavy), "k", "left")
    light = marked.filter("heavy is null").select("fp", "k")
    # The other parts side by side are 64 - width bits, cut into pieces again.
    rest = right("fp", (F.col("i") + 1) * width)
    above = F.when(F.col("i") + 1 < parts, rest).otherwise(F.lit(0).cast("long"))
    below = F.col("fp").bitwiseAND(left(F.lit(1).cast("long"), F.col("i") * width) - 1)
    joined = left(above, F.col("i") * width).bitwiseOR(below)
    piece = -(-(64 - width) // parts)
    again = marked.filter("heavy").withColumn("joined", joined).withColumn("j", F.explode(number))
    value = right("joined", F.col("j") * piece).bitwiseAND(F.lit((1 << piece) - 1))
    return light.unionAll(again.select("fp", (((F.col("k") * parts + F.col("j")) * (1 << piece) + value) + F.lit(1 << 40)).alias("k")))


def links(codes: DataFrame, bits: int = 3, most: int = GROUP_CODES) -> DataFrame:
    """``a, b``: links that connect what at most ``bits`` bits connect, for distinct codes in ``fp``.

    Each task of the join gets whole groups of codes that agree in a part, and gives a forest of them, fewer links than codes.
    """

    def run(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        fp, k = (np.concatenate(x) for x in zip(*got))
        index = GrayIndex(k, fp.view(np.uint64))
        forest = Forest(len(fp))
        for q, m in index.pairs(bits):
            forest.add(q, m)
        every = np.arange(len(fp))
        root = forest.roots(every)
        child = every != root
        sorted_fp = index.codes.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sorted_fp[every[child]]), pa.array(sorted_fp[root[child]])], names=["a", "b"])

    parts = partitions_for(codes.sparkSession, codes.count() * (bits + 1), TASK_CODES)
    return dealt(codes, bits, most).repartition(parts, "k").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of an edge: the smallest node of its component, by alternating stars."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Hangs the larger (or the smaller) neighbours of each node on the smallest of it and its neighbours."""
        near = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if large:
            near = near.unionAll(near.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        hung = near.join(least, "u")
        if large:
            return hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        both = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return both.filter(F.col("a") != F.col("b")).distinct()

    sum_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = staged(edges.filter(F.col("a") != F.col("b")), "links")
    mark = sum_of(now)
    for _ in range(rounds):
        new = staged(star(star(now, True), False), "links")
        drop_staged(now)
        now, before, mark = new, mark, sum_of(new)
        if mark == before:
            break
    else:
        raise RuntimeError("components didn't settle")
    nodes = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return nodes.unionAll(now.select(F.least("a", "b").alias("node"), F.least("a", "b").alias("root"))).distinct()


def groups_of(found: DataFrame, bits: int = 3, edges: DataFrame | None = None) -> DataFrame:
    """``doc_id, fp`` rows with ``component_id``, the smallest doc_id among the rows that links reach, and ``root``.

    Null ids are passed over unless a group has no others. Rows with equal fingerprints are one node. ``edges`` are links
    to take instead of those of at most ``bits`` bits.
    """
    codes = staged(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    trees = staged(components(links(codes.select("fp"), bits) if edges is None else edges), "trees")
    linked = trees.join(codes, trees["node"] == codes["fp"]).select("root", "fp", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(least, "root").select("fp", "root", "component_id")
    own = codes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    own = staged(own, "groups")  # the last join then shuffles both sides, so that Spark splits a fingerprint of many copies
    return found.join(own, "fp")


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row, repeated ones too; an empty table gives no rows.

    Null texts and texts without a word have the fingerprint 0 and are linked like any. Ties don't arise: a component's id
    is its smallest doc_id, and null ids count only where a component has no other.
    """
    found = staged(fingerprints(docs.select("doc_id", "text"), keep=["doc_id"]), "fingerprints")
    out = groups_of(found)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group, that with the smallest (id, text hash); columns as in ``docs``.

    Ids may repeat: the row to keep is chosen by (id, hash of the text), and one of equal rows stays.
    """
    mark = free_name(docs, "text_mark")
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    found = staged(fingerprints(marked.select(F.col(id_col).alias("doc_id"), F.col(mark).alias("mark"), F.col(text_col).alias("text")), keep=["doc_id", "mark"]), "fingerprints")
    return keep_first(marked, groups_of(found), mark, id_col).select(*docs.columns)


def keep_first(marked: DataFrame, per: DataFrame, mark: str, id_col: str) -> DataFrame:
    """The rows of ``marked``, whose text hash is in ``mark``, that come first in the groups ``doc_id, mark, root``.

    If few keys go, or stand for several rows, these are broadcast and no text is shuffled; otherwise the keys that stay are
    joined, and one row of each is kept, by one shuffle.
    """
    names = {c: free_name(marked, f"first_{c}") for c in ("id", "mark", "key")}
    key = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "mark")
    counted = per.groupBy("root", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("root").agg(F.min(key).alias("k"))
    j = counted.join(best, "root").select(F.col("doc_id").alias(names["id"]), F.col("mark").alias(names["mark"]), "n", (key == F.col("k")).alias("stays"))
    j = staged(j.withColumn(names["key"], F.xxhash64(names["id"], names["mark"])), "first-keys")
    place = free_name(marked, "place")
    rows = marked.withColumn(place, F.xxhash64(id_col, mark))
    pick = list(names.values())

    def joined(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        # One key column without nulls, so that the join and the removal of repeated rows share one shuffle of the texts.
        same = (rows[place] == keys[names["key"]]) & rows[id_col].eqNullSafe(keys[names["id"]]) & (rows[mark] == keys[names["mark"]])
        return rows.join(keys, same, how)

    some = j.filter("not stays or n > 1")
    if some.count() <= BROADCAST_ROWS:
        alone = joined(rows, F.broadcast(some.select(*pick)), "left_anti")
        several = joined(rows, F.broadcast(j.filter("stays and n > 1").select(*pick)), "left_semi").dropDuplicates([place, id_col, mark])
        return alone.unionAll(several)
    return joined(rows, j.filter("stays").select(*pick), "left_semi").dropDuplicates([place, id_col, mark])
