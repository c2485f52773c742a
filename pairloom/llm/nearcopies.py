"""Groups of documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8, all of them.

SimHash alone doesn't find them: at a similarity of 0.8 fingerprints differ in about ten of 64 bits, too many for an index
of few bits. So it does the first and larger part, links of at most three bits found by the Gray-order index, and what it
leaves apart is found exactly. Shingles are put in one order, rare ones first; two sets of similarity 0.8 share one of the
first ``m // 5 + 1`` shingles of each (``m`` its size), so documents meet by those and no such pair is missed, whatever the
order. How common a shingle is comes from a sample; that decides how many documents meet, not which groups come out. Every
link is verified on the two texts, after bitmaps of the sets have ruled out most pairs that aren't similar; and only pairs of documents that are still in different components are looked at, so
that a large group of copies isn't compared pair by pair.

Shingles are compared by XXH64; documents with the same set are one node, known by 64 bits of it.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_staged, free_name, partitions_for, small_side, staged
from .simhash import FOLD, components, groups_of, keep_first
from .simhash import links as within_bits

SIZE = 5
BUCKETS = 1 << 20

#: Binary logarithms of set sizes are kept in steps of 1/32; similar sets are at most so many steps apart.
STEPS, APART = 32, 11

#: Bytes of text whose shingles one task should bring together, and members of a meeting that one row should hold.
TASK_TEXT, ROW_MEMBERS = 64 << 20, 4096


def shingles(raw: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted hashes of the distinct shingles, split into words as for fingerprints; fewer words are one shingle."""
    words = [w for w in raw.translate(FOLD).split(b" ") if w]
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())], np.uint64))


def digest_of(s: np.ndarray) -> int:
    """64 bits that stand for a set; 0 for the empty one."""
    return xxhash.xxh64_intdigest(s.tobytes(), 42) if len(s) else 0


def code_of(s: np.ndarray) -> int:
    """The set's SimHash: bit by bit the majority of its shingles' hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(s), 65536):
        ones += np.unpackbits(s[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view(np.uint64)[0])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of at least 0.8, in whole numbers: 9 common >= 4 (sizes)."""
    least = 4 * (len(a) + len(b))
    return 9 * min(len(a), len(b)) >= least and 9 * len(np.intersect1d(a, b, assume_unique=True)) >= least


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each shingle, by the low bits of its hash; twice to four times as many bits as shingles."""
    n = max(64, 1 << (2 * len(s)).bit_length())
    out = np.zeros(n // 8, np.uint8)
    at = (s & np.uint64(n - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.tobytes()


def folded(s: np.ndarray) -> list[int]:
    """The bitmap of 512 bits as eight signed numbers, for comparing sets in Spark's own expressions."""
    out = np.zeros(64, np.uint8)
    at = (s & np.uint64(511)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.view(np.int64).tolist()


def may_be_similar(a: bytes, m: int, b: bytes, n: int) -> bool:
    """False only if sets of ``m`` and ``n`` shingles with these bitmaps can't be similar.

    A bit that one bitmap has alone stands for a shingle, or several, that the other set lacks. The longer bitmap is folded.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    small = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, small), axis=0) if len(v) > small else v for v in (x, y))
    common = min(m - int(np.bitwise_count(x & ~y).sum()), n - int(np.bitwise_count(y & ~x).sum()))
    return 9 * common >= 4 * (m + n)


def described(found: DataFrame) -> DataFrame:
    """``doc_id, mark, fp, code, m, bits, fold``: digest, SimHash, size and bitmaps of the set; one pass over the texts."""
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select("doc_id", "mark").schema.fields)

    def run(batches):
        for b in batches:
            sets = [shingles((x.as_py() or "").encode()) for x in b.column(2)]
            arrays = [pa.array(np.array([of(s) for s in sets], np.uint64).view(np.int64)) for of in (digest_of, code_of)]
            arrays += [pa.array([len(s) for s in sets], pa.int32()), pa.array([bitmap(s) for s in sets], pa.binary()), pa.array([folded(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *arrays], names=["doc_id", "mark", "fp", "code", "m", "bits", "fold"])

    return found.select("doc_id", "mark", "text").mapInArrow(run, f"{types}, fp long, code long, m int, bits binary, fold array<long>")


def common_levels(found: DataFrame) -> np.ndarray:
    """By bucket of shingles the binary logarithm of how many texts of a sample hold the most common one; 0 for rare ones."""

    def run(batches):
        for b in batches:
            sets = [shingles((x.as_py() or "").encode()) for x in b.column(0)]
            h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            several = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(h[several].view(np.int64)), pa.array(n[several].astype(np.int64))], names=["h", "n"])

    some = found.filter(F.pmod("mark", F.lit(8)) == 0).select("text").mapInArrow(run, "h long, n long")
    per = some.groupBy("h").agg(F.sum("n").alias("n"))
    top = per.groupBy(F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).agg(F.floor(F.log2(F.max("n"))).cast("int").alias("level")).toPandas()  # a row a bucket at most
    levels = np.zeros(BUCKETS, np.uint8)
    levels[top["b"].to_numpy(np.int64)] = top["level"].to_numpy(np.int64)
    return levels


def _packed(found: DataFrame, levels: np.ndarray, parts: int) -> DataFrame:
    """``part, items``: the shingles to meet by, dealt to parts by their hash, as records of five bytes of the hash, the
    set's digest and its size in steps. Fewer bits of a hash let more documents meet; links are verified."""

    def run(batches):
        for b in batches:
            known: set[int] = set()
            keys, fps, sizes = [], [], []
            for x in b.column(0):
                s = shingles((x.as_py() or "").encode())
                fp = digest_of(s)
                if not len(s) or fp in known:
                    continue
                known.add(fp)
                order = np.lexsort((s, levels[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]))[: len(s) // 5 + 1]
                keys.append(s[order])
                fps.append(np.full(len(order), fp, np.uint64))
                sizes.append(np.full(len(order), int(np.log2(len(s)) * STEPS), np.uint16))
            if not keys:
                continue
            k, fp, size = np.concatenate(keys), np.concatenate(fps), np.concatenate(sizes)
            part = (k >> np.uint64(40)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            rows = np.empty((len(k), 15), np.uint8)
            rows[:, :5] = k[order].view(np.uint8).reshape(-1, 8)[:, :5]
            rows[:, 5:13] = fp[order].view(np.uint8).reshape(-1, 8)
            rows[:, 13:] = size[order].view(np.uint8).reshape(-1, 2)
            part = part[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            blobs = [rows[i:j].tobytes() for i, j in zip(cuts, np.append(cuts[1:], len(k)))]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "items"])

    return found.select("text").mapInArrow(run, "part int, items binary")


def _mixed(x: np.ndarray, odd: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(odd)
    return x ^ (x >> np.uint64(29))


def _met(packed: DataFrame) -> DataFrame:
    """``g1, g2, chunk, fps, sizes``: the sets that meet at a shingle, two or more, each such group once a task.

    A group is known by 128 bits made of its members; large ones come in rows of a bounded number of members.
    """

    def run(batches):
        held = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, 15).copy() for b in batches for x in b.column(1)]
        if not held:
            return
        rows = np.concatenate(held)
        del held
        k = np.zeros((len(rows), 8), np.uint8)
        k[:, :5] = rows[:, :5]
        k, fp, size = k.view(np.uint64).ravel(), rows[:, 5:13].copy().view(np.uint64).ravel(), rows[:, 13:].copy().view(np.uint16).ravel()
        del rows
        order = np.lexsort((fp, k))
        k, fp, size = k[order], fp[order], size[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (fp[1:] != fp[:-1])])
        k, fp, size = k[new], fp[new], size[new]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.diff(np.append(first, len(k)))
        g1, g2 = (np.add.reduceat(_mixed(fp, odd), first) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
        several = np.flatnonzero(count > 1)
        _, once = np.unique(np.stack([g1[several], g2[several]]), axis=1, return_index=True)
        out: list[tuple] = []
        for g in several[np.sort(once)]:
            for at, i in enumerate(range(first[g], first[g] + count[g], ROW_MEMBERS)):
                j = min(i + ROW_MEMBERS, first[g] + count[g])
                out.append((g1[g], g2[g], at, fp[i:j].view(np.int64), size[i:j].astype(np.int32)))
            if len(out) >= 2000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out):
        c = list(zip(*out))
        cols = [pa.array(np.array(c[0], np.uint64).view(np.int64)), pa.array(np.array(c[1], np.uint64).view(np.int64)), pa.array(c[2], pa.int32()), pa.array(c[3], pa.list_(pa.int64())), pa.array(c[4], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(cols, names=["g1", "g2", "chunk", "fps", "sizes"])

    return packed.mapInArrow(run, "g1 long, g2 long, chunk int, fps array<long>, sizes array<int>")


def meetings(found: DataFrame, text_bytes: int) -> DataFrame:
    """``g1, g2, fp, size``: each group of sets that meet at a shingle once, a row a member."""
    parts = partitions_for(found.sparkSession, text_bytes, TASK_TEXT)
    groups = _met(_packed(found, common_levels(found), parts).repartition(parts, "part")).distinct()
    return staged(groups, "meetings").select("g1", "g2", F.explode(F.arrays_zip("fps", "sizes")).alias("x")).select("g1", "g2", F.col("x.fps").alias("fp"), F.col("x.sizes").alias("size"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``a, b`` whose texts are similar."""

    def run(batches):
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(fp: int, text) -> np.ndarray:
            if fp not in known:
                known[fp] = shingles((text.as_py() or "").encode())
                if len(known) > 100:
                    known.popitem(last=False)
            known.move_to_end(fp)
            return known[fp]

        for x in batches:
            a, b = x.column(0).to_pylist(), x.column(1).to_pylist()
            ok = np.array([similar(of(p, s), of(q, t)) for p, q, s, t in zip(a, b, x.column(2), x.column(3))], bool)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in x.columns[:2]], names=["a", "b"])

    both = pairs.join(texts.select(F.col("fp").alias("a"), F.col("text").alias("s")), "a").join(texts.select(F.col("fp").alias("b"), F.col("text").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``a, b`` whose bitmaps allow that the sets are similar."""

    def run(batches):
        for x in batches:
            ok = [may_be_similar(*row) for row in zip(*(x.column(k).to_pylist() for k in range(2, 6)))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in x.columns[:2]], names=["a", "b"])

    side = lambda k: sets.select(F.col("fp").alias(k), F.col("bits").alias(f"{k}_bits"), F.col("m").alias(f"{k}_m"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_bits", "a_m", "b_bits", "b_m").mapInArrow(run, "a long, b long")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b")).distinct()


def links(found: DataFrame, sets: DataFrame, met: DataFrame) -> DataFrame:
    """``a, b``: verified links that connect all that are similar."""
    asked = staged(sets.join(met.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min(F.struct("mark", "code", "m", "bits", "fold")).alias("s")).select("fp", "s.*"), "asked")

    def similar_of(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs, "pairs")
        some = staged(possible(pairs, asked), "possible")
        wanted = some.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
        marks = staged(asked.select("fp", "mark").join(wanted, "fp", "left_semi"), "wanted")
        texts = staged(found.select("mark", "text").join(small_side(marks), "mark").dropDuplicates(["fp"]).select("fp", "text"), "texts")
        near = staged(verified(some, texts), "near")
        drop_staged(pairs, some, marks, texts)
        return near

    # By SimHash: sets of one code hang on the smallest of them, and codes of at most three bits are linked.
    codes = staged(asked.groupBy("code").agg(F.min("fp").alias("head")), "codes")
    same = asked.join(codes, "code").filter("fp <> head").select("fp", F.col("head").alias("fp2"))
    ends = [codes.select(F.col("code").alias(c), F.col("head").alias(h)) for c, h in (("a", "fp"), ("b", "fp2"))]
    near_codes = within_bits(codes.select(F.col("code").alias("fp"))).join(ends[0], "a").join(ends[1], "b").select("fp", "fp2")
    near = similar_of(ordered(same.unionAll(near_codes)))

    def placed(near: DataFrame) -> DataFrame:
        """Groups whose members are in different components, with the component that most are in."""
        trees = staged(components(near).withColumnRenamed("node", "fp"), "trees")
        rows = met.join(trees, "fp", "left").select("g1", "g2", "fp", "size", F.coalesce("root", "fp").alias("root"))
        usual = rows.groupBy("g1", "g2").agg(F.mode("root", True).alias("usual"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("g1", "g2", "usual")
        out = staged(rows.join(usual, ["g1", "g2"]), "placed")
        drop_staged(trees)
        return out

    # Then each member that is elsewhere is held against two of the component that most members of its group are in, others
    # in each group; again for those that are left.
    spread = F.xxhash64("g1", "fp")
    for _ in range(2):
        now = placed(near)
        hubs = now.filter("root = usual").groupBy("g1", "g2").agg(F.min_by(F.struct("fp", "size"), spread).alias("lo"), F.max_by(F.struct("fp", "size"), spread).alias("hi"))
        odd = now.filter("root <> usual").join(hubs, ["g1", "g2"]).select("fp", "size", F.explode(F.array("lo", "hi")).alias("e"))
        near = near.unionAll(similar_of(ordered(odd.filter(F.abs(F.col("size") - F.col("e.size")) <= APART).select("fp", F.col("e.fp").alias("fp2")))))
        drop_staged(now)

    # What is still apart is compared, as far as bitmaps allow. Of two members in different components at most one is in
    # the usual one.
    now = placed(near)
    known = now.drop("size").join(asked.select("fp", "m", "fold"), "fp")
    other = known.select("g1", "g2", *[F.col(c).alias(f"{c}2") for c in ("fp", "root", "m", "fold")])
    alone = lambda a, b: sum((F.bit_count(F.col(a)[k].bitwiseAND(F.bitwise_not(F.col(b)[k]))) for k in range(8)), F.lit(0))
    common = F.least(F.col("m") - alone("fold", "fold2"), F.col("m2") - alone("fold2", "fold"))
    apart = known.filter("root <> usual").join(other, ["g1", "g2"]).filter((F.col("root") != F.col("root2")) & (9 * common >= 4 * (F.col("m") + F.col("m2"))))
    near = near.unionAll(similar_of(ordered(apart)))
    drop_staged(now, asked, codes)
    return near


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that with the smallest (id, text hash); columns as in ``docs``.

    Null texts and texts without a word are one group. Ids may repeat or be null: the row to keep is chosen by (id, hash
    of the text), null ids last, and one of rows with equal ids and texts stays. An empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    mark = free_name(docs, "text_mark")
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    found = marked.select(F.col(id_col).alias("doc_id"), F.col(mark).alias("mark"), F.col(text_col).alias("text"))
    sets = staged(described(found), "sets")
    met = meetings(found, found.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    per = groups_of(sets.select("doc_id", "mark", "fp"), edges=links(found, sets, met))
    return keep_first(marked, per, mark, id_col).select(*docs.columns)
