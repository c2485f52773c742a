"""Repeated byte strings by suffix arrays, sorted deep-shallow.

A string that repeats has the same smallest hash among its short substrings wherever it stands. So every window of
``length`` bytes is keyed by the smallest hash of its ``gram``-byte substrings; windows side by side with one key form a
run, and only runs whose key occurs again can hold a repeat. Their bytes go, by key, to tasks that sort all suffixes of
what they got: by multikey quicksort with 8-byte characters to a shallow depth, then, where long prefixes are shared, by
blind tries that look at branching bytes only. Neighbours with ``length`` common bytes are repeats.

A key with more runs than a task should hold is dealt to several tasks. Each sorts what it has; what it found single meets
what other tasks have by 128-bit digests of windows, which is exact up to collisions of such digests. Results don't depend
on where that limit is, and tests hold limits of one run, of 500 and none against each other. Equal runs are stored once
per task, with their number. Very long texts are worked on in pieces that overlap by a window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_staged, partitions_for, staged, text_bytes

LENGTH, GRAM = 200, 40

#: Runs are cut after so many windows, so that periodic texts have short runs too.
LONGEST_RUN = 256

#: Runs that one sorting task should hold.
TASK_RUNS = 20_000

#: A key of more runs than this is dealt to several tasks, so that none waits for a hot passage.
CROWD = 500

#: Windows of a text, or bytes of several short ones, that are worked on together.
PIECE = 1 << 22

#: Depth in bytes to which multikey quicksort goes.
SHALLOW = 32

_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


class _Hash:
    """Hashes of all ``gram``-byte substrings: differences of prefix sums of weighted random byte values, modulo 2**64."""

    def __init__(self, gram: int, length: int):
        self.gram, self.window = gram, length - gram + 1
        n = _BLOCK + length + 8
        rnd = np.random.default_rng(20240607)
        self.values = rnd.integers(0, 1 << 64, 256, np.uint64)
        inverse = pow(_BASE, -1, 1 << 64)
        self.power, self.unpower = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, inverse))

    def smallest(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window of ``length`` bytes the smallest hash of its substrings; 16 bits of every substring's hash."""
        count = len(data) - self.gram - self.window + 2
        out = np.empty(max(0, count), np.uint64)
        brief = np.empty(max(0, len(data) - self.gram + 1), np.uint16)
        for at in range(0, count, _BLOCK):
            part = data[at : at + _BLOCK + self.gram + self.window - 2]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(self.values[part] * self.power[: len(part)], out=sums[1:])
            h = (sums[self.gram :] - sums[: -self.gram]) * self.unpower[: len(part) - self.gram + 1]
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            brief[at : at + len(h)] = h.astype(np.uint16)
            span = 1
            while span * 2 <= self.window:
                h = np.minimum(h[:-span], h[span:])
                span *= 2
            rest = self.window - span
            out[at : at + _BLOCK] = np.minimum(h[: len(h) - rest], h[rest:])
        return out, brief

    def repeats_inside(self, brief: np.ndarray, first: np.ndarray, last: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Whether a run's key may come twice in its own bytes, so that its windows may equal each other.

        Its first and last window cover them unless the run is longer than a window, which counts as twice.
        """
        view = np.lib.stride_tricks.sliding_window_view(brief, self.window)
        twice = last - first > self.window
        want = key.astype(np.uint16)[:, None]
        for i in range(0, len(first), 4096):
            a, b = view[first[i : i + 4096]] == want[i : i + 4096], view[last[i : i + 4096] - 1] == want[i : i + 4096]
            apart = first[i : i + 4096] + a.argmax(1) != last[i : i + 4096] - 1 + b.argmax(1)
            twice[i : i + 4096] |= (a.sum(1) > 1) | (b.sum(1) > 1) | apart
        return twice


def runs_of(data: np.ndarray, ends: np.ndarray, hasher: _Hash, length: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, key, whether the key may come twice inside) of the runs of the documents that
    ``data`` holds one after another."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    has = np.flatnonzero(ends - starts >= length)
    if not len(has):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    key, brief = hasher.smallest(data)
    edge = np.zeros(len(key) + 1, bool)
    edge[1:-1] = key[1:] != key[:-1]
    edge[starts[has]] = True
    stop = ends[has] - length + 1
    edge[stop] = True
    first = np.flatnonzero(edge[:-1])
    last = np.append(first[1:], len(key))
    doc = np.searchsorted(ends, first, side="right")
    inside = first + length <= ends[doc]
    first, last, doc = first[inside], last[inside], doc[inside]
    pieces = (last - first + LONGEST_RUN - 1) // LONGEST_RUN
    if pieces.max() > 1:
        step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        doc, last = np.repeat(doc, pieces), np.repeat(last, pieces)
        first = np.repeat(first, pieces) + step * LONGEST_RUN
        last = np.minimum(last, first + LONGEST_RUN)
    return doc, first - starts[doc], last - first, key[first], hasher.repeats_inside(brief, first, last, key[first])


def deep_shallow_sort(data: bytes, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places ordered by the ``length`` bytes that follow them, and whether each shares all with the one before."""
    n = len(places)
    buffer = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ndarray((len(data) + 1,), ">u8", buffer=buffer, strides=(1,))
    word_at = lambda p, d: words[p + d].astype(np.uint64)
    order = np.argsort(word_at(places, 0), kind="stable")
    first = word_at(places[order], 0)
    new = np.ones(n, bool)
    new[1:] = first[1:] != first[:-1]
    shallow = min(SHALLOW, length // 8 * 8)
    for depth in range(8, shallow, 8):  # multikey quicksort: parts of equal prefixes are sorted by their next characters
        group = np.cumsum(new)
        live = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(live):
            return places[order], np.zeros(n, bool)
        c = word_at(places[order[live]], depth)
        turn = np.lexsort((c, group[live]))
        order[live] = order[live][turn]
        c, g = c[turn], group[live]
        new[live[1:]] |= (c[1:] != c[:-1]) | (g[1:] != g[:-1])
    # Blind tries, all parts a level at a time: a node knows only how deep its members agree and branches on the next byte.
    known = np.full(n, shallow, np.int64)
    done = np.zeros(n, bool)
    while True:
        alone = new & np.append(new[1:], True)
        live = np.flatnonzero(~alone & ~done)
        if not len(live):
            break
        begins = np.flatnonzero(new[live])
        sizes = np.diff(np.append(begins, len(live)))
        p = places[order[live]]
        leader = np.repeat(p[begins], sizes)
        agree = np.full(len(live), length, np.int64)
        left, depth = np.flatnonzero(p != leader), known[live]
        while len(left):
            d = np.minimum(depth[left], max(0, length - 8))
            x = word_at(p[left], d) ^ word_at(leader[left], d)
            differ = x != 0
            if differ.any():
                y = x[differ]
                zeros = np.zeros(len(y), np.int64)
                for k, shift in enumerate((56, 48, 40, 32, 24, 16, 8)):
                    zeros += (y >> np.uint64(shift)) == 0
                agree[left[differ]] = np.minimum(length, d[differ] + zeros)
            depth[left] = d + 8
            left = left[~differ & (d + 8 < length)]
        branch = np.repeat(np.minimum.reduceat(agree, begins), sizes)
        equal = branch >= length
        done[live[equal]] = True
        rest = np.flatnonzero(~equal)
        if len(rest):
            group = np.repeat(np.arange(len(begins)), sizes)[rest]
            c = buffer[p[rest] + branch[rest]]
            turn = np.lexsort((c, group))
            at = live[rest]
            order[at] = order[at][turn]
            c = c[turn]
            new[at[1:]] |= (c[1:] != c[:-1]) | (group[1:] != group[:-1])
            known[at] = branch[rest]
    return places[order], ~new


def _pieces(offsets: np.ndarray, length: int):
    """(first text, ends of texts, first byte, first window) of what to work on together: short texts side by side, and
    parts of one long text, each window in one of them."""
    sizes = np.diff(offsets)
    k = 0
    while k < len(sizes):
        if sizes[k] > PIECE:
            for base in range(0, max(1, int(sizes[k]) - length + 1), PIECE):
                yield k, np.array([min(int(sizes[k]), base + PIECE + length - 1) - base]), int(offsets[k]) + base, base
            k += 1
            continue
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PIECE, side="right")) - 1)
        while stop > k + 1 and (sizes[k:stop] > PIECE).any():
            stop -= 1
        if offsets[stop] > offsets[k]:
            yield k, offsets[k + 1 : stop + 1] - offsets[k], int(offsets[k]), 0
        k = stop


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = text_bytes(text_col)
    th = F.xxhash64(raw)
    return docs.select(F.col(id_col).alias("doc_id"), th.alias("th"), raw.alias("raw"), F.xxhash64(id_col, th).alias("dh"))


def _runs(keyed: DataFrame, kind: str, length: int, gram: int) -> DataFrame:
    """Runs with key ``m``. A key that comes twice within a batch or a run is known to repeat: its runs pass on as such, and one
    more row tells the others, so that a key of very many runs brings a row a batch to its task."""

    def run(batches):
        hasher = _Hash(gram, length)
        for b in batches:
            raw = b.column(2)
            offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
            if offsets[-1] == offsets[0]:
                continue
            every = np.frombuffer(raw.buffers()[2], np.uint8)
            for at, ends, begin, base in _pieces(offsets, length):
                doc, start, count, key, twice = runs_of(every[begin : begin + ends[-1]], ends, hasher, length)
                if not len(doc):
                    continue
                doc, start = doc + at, start + base
                values, back, times = np.unique(key, return_inverse=True, return_counts=True)
                known = (times[back] > 1) | twice
                th = b.column(1).to_numpy()[doc]
                row = b.column(3).to_numpy()[doc] ^ (start * 0x9E3779B1)  # by document too, so that copies part
                deal = np.where(known, row, key.view(np.int64))
                told = np.unique(key[known])
                pad = lambda x, v: np.concatenate([x, np.full(len(told), v, x.dtype)])  # noqa: B023, E731
                ids = pa.concat_arrays([b.column(0).take(pa.array(doc)), pa.nulls(len(told), b.column(0).type)])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(pad(th, 0)), pa.array(pad(start, -1).astype(np.int32)), pa.array(pad(count, 0).astype(np.int32)),
                        pa.array(np.concatenate([key, told]).view(np.int64)), pa.array(pad(known, False)), pa.array(np.concatenate([deal, told.view(np.int64)])),
                    ],
                    names=["doc_id", "th", "start", "count", "m", "known", "deal"],
                )

    return keyed.mapInArrow(run, f"doc_id {kind}, th long, start int, count int, m long, known boolean, deal long")


def _candidates(runs: DataFrame, kind: str, parts: int) -> DataFrame:
    """Runs whose key occurs again anywhere."""

    def run(batches):
        held = []
        for b in batches:
            known = b.column(5).to_numpy(zero_copy_only=False)
            out = pa.RecordBatch.from_arrays(list(b.columns[:5]), names=b.schema.names[:5])
            if known.any():
                yield out.filter(pa.array(known))
            if not known.all():
                held.append(out.filter(pa.array(~known)))
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            m = rows.column(4).to_numpy()
            _, back, times = np.unique(m, return_inverse=True, return_counts=True)
            keep = (times[back] > 1) & (rows.column(2).to_numpy() >= 0)
            yield from rows.filter(pa.array(keep)).to_batches(max_chunksize=100_000)

    return runs.repartition(parts, "deal").mapInArrow(run, f"doc_id {kind}, th long, start int, count int, m long")


def _segments(found: DataFrame, kind: str, length: int) -> DataFrame:
    """The bytes of each candidate run, with the task key ``m, salt``."""

    def run(batches):
        for b in batches:
            ids, th, raws, marks = b.column(0), b.column(1).to_pylist(), b.column(2), b.column(4).to_pylist()
            runs = b.column(3)
            size = runs.value_lengths().to_numpy()
            flat = runs.flatten()
            starts, counts, keys, tasks = (flat.field(c).to_numpy() for c in ("start", "count", "m", "tasks"))
            salts = np.where(tasks > 0, 1 + (np.repeat(np.array(marks, np.int64), size) ^ starts.astype(np.int64) * 0x9E3779B1) % np.maximum(tasks, 1), 0)
            rows, bytes_, held, at = [], [], 0, 0
            for k in range(len(size)):
                raw = raws[k].as_buffer().to_pybytes()
                for r in range(at, at + int(size[k])):
                    s = starts[r]
                    bytes_.append(raw[s : s + counts[r] - 1 + length])
                    rows.append((k, r))
                    held += len(bytes_[-1])
                    if held > 4 << 20:
                        yield pack(ids, th, rows, starts, keys, salts, bytes_)
                        rows, bytes_, held = [], [], 0
                at += int(size[k])
            if rows:
                yield pack(ids, th, rows, starts, keys, salts, bytes_)

    def pack(ids, th, rows, starts, keys, salts, bytes_):
        doc, run = np.array(rows).T
        cols = [ids.take(pa.array(doc)), pa.array([th[k] for k in doc.tolist()], pa.int64()), pa.array(starts[run].astype(np.int32)), pa.array(keys[run]), pa.array(salts[run].astype(np.int32)), pa.array(bytes_, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "start", "m", "salt", "segment"])

    return found.mapInArrow(run, f"doc_id {kind}, th long, start int, m long, salt int, segment binary")


def _marked(segments: DataFrame, kind: str, buckets: int, length: int) -> DataFrame:
    """Sorts the suffixes of each task. Rows have either a range [first, last) of repeated windows of a document, or,
    in ``bucket``, the digests of the windows of crowded keys with the document of those that are single here."""

    names = ["doc_id", "th", "first", "last", "bucket", "digests", "ids", "ths", "starts", "single"]

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        del held
        ids, th, start, salt = table.column(0).combine_chunks(), table.column(1).to_numpy(), table.column(2).to_numpy(), table.column(4).to_numpy()
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.chunk(0)
        unique: dict[bytes, int] = {}
        which = np.array([unique.setdefault(x, len(unique)) for x in table.column(5).to_pylist()])
        del table
        weight = np.bincount(which)
        sizes = np.fromiter(map(len, unique), np.int64, len(unique))
        data = b"".join(unique)
        offset = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        begin = np.cumsum(windows) - windows
        owner = np.repeat(np.arange(len(sizes)), windows)
        places = np.arange(len(owner)) - np.repeat(begin - offset, windows)
        ordered, same = deep_shallow_sort(data, places, length)
        seg = np.searchsorted(offset, ordered, side="right") - 1
        heads = np.flatnonzero(~same)
        total = np.add.reduceat(weight[seg], heads)
        times = np.repeat(total, np.diff(np.append(heads, len(ordered))))
        multi = np.zeros(len(owner), bool)
        multi[begin[seg] + ordered - offset[seg]] = times > 1
        # Ranges of repeated windows of each different run, then of each row that has it.
        flat = np.concatenate([[False], multi, [False]])
        edge = flat[1:] != flat[:-1]
        edge[begin] |= flat[1:][begin] & flat[:-1][begin]
        a = np.flatnonzero(edge[:-1] & flat[1:-1])
        stop = np.flatnonzero(edge)
        z = stop[np.searchsorted(stop, a, side="right")]
        of = owner[a] if len(a) else np.zeros(0, np.int64)
        lo, hi = np.searchsorted(of, which), np.searchsorted(of, which, side="right")
        n = hi - lo
        row = np.repeat(np.arange(len(which)), n)
        pick = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        shift = start[row] - begin[which[row]]
        for i in range(0, len(row), 100_000):
            r = row[i : i + 100_000]
            yield rows_of(ids.take(pa.array(r)), th[r], (a[pick] + shift)[i : i + 100_000], (z[pick] + shift)[i : i + 100_000])
        crowded = salt > 0
        if crowded.any():
            member = np.zeros(len(sizes), np.int64) - 1
            member[which[crowded]] = np.flatnonzero(crowded)
            mine = np.flatnonzero(member[seg[heads]] >= 0)
            digests, owners, at, single = [], [], [], []
            for h in mine:
                p = int(ordered[heads[h]])
                digests.append(hashlib.blake2b(data[p : p + length], digest_size=16).digest())
                s = seg[heads[h]]
                owners.append(int(member[s]))
                at.append(int(start[member[s]] + p - offset[s]))
                single.append(bool(total[h] == 1))
            bucket = np.array([int.from_bytes(d[:4], "little") % buckets for d in digests])
            for k in np.unique(bucket):
                j = np.flatnonzero(bucket == k)
                o = [owners[i] for i in j]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.nulls(1, ids.type), pa.array([0]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.array([int(k)], pa.int32()), pa.array([b"".join(digests[i] for i in j)], pa.binary()),
                        pa.array([ids.take(pa.array(o)).to_pylist()], pa.list_(ids.type)), pa.array([th[o].tolist()], pa.list_(pa.int64())),
                        pa.array([[at[i] for i in j]], pa.list_(pa.int32())), pa.array([[single[i] for i in j]], pa.list_(pa.bool_())),
                    ],
                    names=names,
                )

    def rows_of(ids, th, first, last):
        n = len(ids)
        empty = [pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.list_(ids.type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()))]
        return pa.RecordBatch.from_arrays([ids, pa.array(th), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), *empty], names=names)

    return segments.mapInArrow(run, f"doc_id {kind}, th long, first int, last int, bucket int, digests binary, ids array<{kind}>, ths array<long>, starts array<int>, single array<boolean>")


def _across(pending: DataFrame, kind: str, parts: int) -> DataFrame:
    """Windows that are single in their task and have an equal in another."""

    def run(batches):
        digests, ids, ths, starts, single = [], [], [], [], []
        id_type = None
        for b in batches:
            id_type = b.schema.field(1).type.value_type
            digests += b.column(0).to_pylist()
            for out, k in ((ids, 1), (ths, 2), (starts, 3), (single, 4)):
                for x in b.column(k).to_pylist():
                    out += x
        if not digests:
            return
        _, back, times = np.unique(np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2), axis=0, return_inverse=True, return_counts=True)
        hit = np.flatnonzero((times[back.ravel()] > 1) & np.array(single))
        at = np.array(starts, np.int32)[hit]
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in hit], id_type), pa.array(np.array(ths, np.int64)[hit]), pa.array(at), pa.array(at + 1, pa.int32())], names=["doc_id", "th", "first", "last"])

    rows = pending.repartition(parts, "bucket").select("digests", "ids", "ths", "starts", "single")
    return rows.mapInArrow(run, f"doc_id {kind}, th long, first int, last int")


def _cut(found: DataFrame, kind: str, length: int) -> DataFrame:
    def run(batches):
        for b in batches:
            out = []
            lists = b.column(3)
            size, flat = lists.value_lengths().to_numpy(), lists.flatten()
            every = np.stack([flat.field(c).to_numpy() for c in ("first", "last")], 1).astype(np.int64)
            for k, (i, n) in enumerate(zip(np.cumsum(size) - size, size)):
                raw = memoryview(b.column(2)[k].as_buffer())
                r = every[i : i + n]
                r = r[np.argsort(r[:, 0], kind="stable")]
                stop = np.maximum.accumulate(np.minimum(r[:, 1] - 1 + length, len(raw)))
                new = np.concatenate([[True], r[1:, 0] > stop[:-1]])
                spans = list(zip(r[new, 0].tolist(), stop[np.append(new[1:], True)].tolist()))
                kept, at = hashlib.sha256(), 0
                for a, z in [*spans, (len(raw), len(raw))]:
                    kept.update(raw[at:a])
                    at = z
                out.append((sum(z - a for a, z in spans), [list(s) for s in spans], kept.hexdigest()))
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["doc_id", "th", "n_removed", "spans", "kept_sha256"])

    return found.mapInArrow(run, f"doc_id {kind}, th long, n_removed long, spans array<array<long>>, kept_sha256 string")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, task_runs: int = TASK_RUNS, crowd: int = CROWD) -> DataFrame:
    """``doc_id, th, n_removed, spans, kept_sha256`` of the documents that have repeats, once for equal (id, text) rows.

    ``th`` is the 64-bit hash of the text, ``spans`` the merged [first, end) ranges of bytes that a repeat covers. Texts
    shorter than ``length``, null ones too, have none; equal rows repeat each other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = _keys(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    found = staged(_candidates(_runs(keyed, kind, length, gram), kind, partitions_for(spark, size, 128 << 20)), "repeat-runs")
    total = found.count()
    hot = staged(found.groupBy("m").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("m", F.ceil(F.col("n") / crowd).cast("int").alias("tasks")), "repeat-crowds")
    crowds, hot_rows = hot.count(), hot
    if crowds <= 100_000:  # some MB at most; a longer list is joined by shuffling
        hot = F.broadcast(hot)
    deal = F.struct("start", "count", "m", F.coalesce("tasks", F.lit(0)).alias("tasks"))
    parts = partitions_for(spark, total, task_runs)
    listed = found.join(hot, "m", "left").groupBy("doc_id", "th").agg(F.collect_set(deal).alias("runs")).withColumnsRenamed({"doc_id": "i", "th": "t"})
    texts = keyed.join(listed, (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("i"))).select("doc_id", "th", "raw", "runs", "dh")
    texts = staged(texts, "repeat-texts")
    drop_staged(found, hot_rows)
    segments = _segments(texts, kind, length).repartition(parts, "m", "salt")
    marked = staged(_marked(segments, kind, parts, length), "repeat-marks")
    marks = marked.filter(F.col("bucket").isNull()).select("doc_id", "th", "first", "last")
    if crowds:
        marks = marks.unionAll(_across(marked.filter(F.col("bucket").isNotNull()), kind, parts))
    ranges = marks.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "last")).alias("ranges")).withColumnsRenamed({"doc_id": "i", "th": "t"})
    cut = texts.select("doc_id", "th", "raw").join(ranges, (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("i"))).select("doc_id", "th", "raw", "ranges")
    return _cut(cut, kind, length).dropDuplicates(["doc_id", "th"])


def removals(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row; a null text counts as empty."""
    found = repeats(docs.select("doc_id", "text")).withColumnsRenamed({"doc_id": "i", "th": "t"})
    raw = text_bytes("text")
    rows = docs.select("doc_id", F.xxhash64(raw).alias("th"), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"))
    rows = rows.join(found, (F.col("th") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("i")), "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce(F.size("spans").cast("long"), zero).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )


#: The rows of ``removals`` in DuckDB's SQL.
REMOVALS_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (SELECT rid, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200
), again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM (SELECT rid, i, md5(b[i:i + 199]) AS h FROM w)) WHERE c > 1
), marked AS (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM again
), spans AS (SELECT rid, min(i) AS a, max(i) + 199 AS z FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS s FROM marked) GROUP BY rid, s
), pieces AS (
  SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) + 1 AS x, a - 1 AS y FROM spans
  UNION ALL SELECT rid, max(z) + 1, 1000000000000 FROM spans GROUP BY rid
), kept AS (SELECT rid, string_agg(hex(b[x:least(y, octet_length(b))]), '' ORDER BY x) AS bytes FROM pieces JOIN d USING (rid) WHERE x <= least(y, octet_length(b)) GROUP BY rid
), n AS (SELECT rid, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN n_removed IS NULL THEN b ELSE unhex(coalesce(bytes, '')) END) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)
"""
