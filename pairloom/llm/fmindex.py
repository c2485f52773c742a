"""Benchmark decontamination by an FM-index per shard of training text.

All words of a shard become symbols. The shard is indexed: suffix array, Burrows-Wheeler transform, wavelet tree, sampled
suffix positions. All test phrases are searched backward at once, occurrences are located, and overlapping spans merge.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop_staged, free_name, staged

#: Lower case for A-Z; other ASCII but digits and letters separates words; the rest stays.
FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


class WaveletTree:
    """Level-wise wavelet tree over symbols below 2**bits, with ranks by counts per 64-bit word and popcounts."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.levels = []
        now = symbols.astype(np.int32)
        for level in range(bits - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 + (-len(bit)) % 64, bool)]), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32)
            zeros = int(len(bit) - bit.sum())
            self.levels.append((packed, before, zeros))
            now = np.concatenate([now[~bit], now[bit]])

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        packed, before, _ = level
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & mask).astype(np.int64)

    def ranks(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``ends`` symbols."""
        lo, hi = np.zeros_like(ends), ends.copy()
        for k, level in enumerate(self.levels):
            one = ((symbols >> (self.bits - 1 - k)) & 1).astype(bool)
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = np.where(one, level[2] + a, lo - a), np.where(one, level[2] + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at these places, and how often each is before its place."""
        lo, hi, symbols = np.zeros_like(at), at.copy(), np.zeros_like(at)
        for level in self.levels:
            one = ((level[0][hi >> 6] >> (hi & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = np.where(one, level[2] + a, lo - a), np.where(one, level[2] + b, hi - b)
            symbols = symbols * 2 + one
        return symbols, hi - lo


def suffix_array(text: np.ndarray, separator: int = 0) -> np.ndarray:
    """The order of all suffixes, separators sorting by their place before all else; symbols are below 2**31.

    Prefix doubling: suffixes are ordered by their first 2, 4, 8 ... symbols; those that are alone in their order by then
    are settled, so that later rounds sort only what repeats.
    """
    n = len(text)
    parts = np.cumsum(text == separator)
    rank = np.where(text == separator, parts - 1, text.astype(np.int64) + int(parts[-1] if n else 0))
    order = np.argsort(rank)
    ordered = rank[order]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(head, n))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, size)  # the rank of a group is the place of its first member
    at = np.flatnonzero(np.repeat(size, size) > 1)  # places of the order that aren't settled
    step = 1
    while len(at):
        who = order[at]
        second = np.where(who + step < n, rank[np.minimum(who + step, n - 1)], -1)
        key = rank[who] * np.int64(n + 1) + second + 1
        turn = np.argsort(key)
        who, key = who[turn], key[turn]
        order[at] = who
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(at)))
        # Unsettled groups fill neighbouring places, so a new group begins where its first member stands.
        rank[who] = np.repeat(at[head], size)
        at = at[np.repeat(size, size) > 1]
        step *= 2
    return order


class FMIndex:
    """Index of a text of symbols: 0 separates runs, each separator sorting by its place; ``starts`` are run starts."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, sample: int = 8):
        n = self.n = len(text)
        sa = suffix_array(text)
        top = int(text.max()) + 1 if n else 1
        bwt = text[sa - 1]  # before the first symbol comes the last, a separator
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top))]).astype(np.int64)
        self.top = top
        self.tree = WaveletTree(bwt, max(1, int(top - 1).bit_length()))
        marked = np.zeros(n, bool)
        marked[::sample] = True
        marked[starts] = True
        self.marked = marked[sa]
        self.at_mark = np.where(self.marked, np.cumsum(self.marked) - 1, 0).astype(np.int32)
        self.sampled = sa[self.marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffix array that begin with each phrase; phrases are padded at the end."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > back) & (lo < hi))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - back].astype(np.int64)
            known = symbol < self.top
            hi[live[~known]] = lo[live[~known]]
            live, symbol = live[known], symbol[known]
            base = self.first[symbol]
            lo[live], hi[live] = base + self.tree.ranks(symbol, lo[live]), base + self.tree.ranks(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix array rows: steps back until a row whose place was sampled."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.marked[at])
        while len(live):
            symbol, before = self.tree.access(at[live])
            at[live] = self.first[symbol] + before
            steps[live] += 1
            live = live[~self.marked[at[live]]]
        return self.sampled[self.at_mark[at]] + steps


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


class Phrases:
    """The different windows of a block of benchmark items, as rows of a table of word numbers from 1."""

    def __init__(self, items: list[tuple], size: int = 10):
        ids: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        self.items = [str(i) for i, _ in items]
        tables, owners = [], []
        for k, (_, text) in enumerate(items):
            words = words_of((text or "").encode())
            seq = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
            if 0 < len(seq) < size:
                seq = np.pad(seq, (0, size - len(seq)))
            if len(seq):
                tables.append(np.unique(np.lib.stride_tricks.sliding_window_view(seq, size), axis=0))
                owners.append(np.full(len(tables[-1]), k, np.int64))
        self.words = list(ids)
        every = np.concatenate(tables) if tables else np.zeros((0, size), np.int32)
        self.table, which = np.unique(every, axis=0, return_inverse=True)
        self.lengths = (self.table > 0).sum(1).astype(np.int64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(which.ravel(), kind="stable")
        self.owners = owner[order]  # the items that have each window, one window after another
        self.begins = np.searchsorted(which.ravel()[order], np.arange(len(self.table) + 1))

    def match(self, docs: list[np.ndarray], ids: dict[bytes, int]) -> list[tuple[list[tuple[int, int]], list[str]]]:
        """For each document of a shard, given as its words' numbers in ``ids``: merged spans of hit words, and the items
        that have occurring windows."""
        ends = np.cumsum([len(d) + 1 for d in docs])
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64) if docs else np.zeros(0, np.int64)
        shard = np.concatenate([x for d in docs for x in (d, [0])]).astype(np.int32) if docs else np.zeros(0, np.int32)
        spans: list[list] = [[] for _ in docs]
        items: list[set] = [set() for _ in docs]
        # The benchmark's words in the shard's numbers; a window with a word that the shard lacks isn't there.
        number = np.fromiter((ids.get(w, 0) for w in self.words), np.int64, len(self.words))
        table = np.concatenate([[0], number])[self.table]
        here = np.flatnonzero(((table > 0) | (self.table == 0)).all(1))
        if not len(shard) or not len(here):
            return [(s, []) for s in spans]
        index = FMIndex(shard, first)
        lo, hi = index.search(table[here], self.lengths[here])
        hit = np.flatnonzero(hi > lo)
        n = (hi - lo)[hit]
        rows = np.repeat(lo[hit], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        which = np.repeat(here[hit], n)
        where = index.locate(rows)
        cover = np.zeros(len(shard) + 1, np.int64)
        np.add.at(cover, where, 1)
        np.add.at(cover, where + self.lengths[which], -1)
        edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            d = int(np.searchsorted(ends, a, side="right"))
            spans[d].append((int(a - first[d]), int(b - first[d])))
        owner = np.searchsorted(ends, where, side="right")
        for d, w in np.unique(np.stack([owner, which]), axis=1).T.tolist():
            items[d].update(self.items[k] for k in self.owners[self.begins[w] : self.begins[w + 1]].tolist())
        return [(s, sorted(i)) for s, i in zip(spans, items)]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def cut(text: str, spans: list) -> str:
    """The text without the words of the spans and what is between them."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(FOLD))]
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, size: int = 10, shard_bytes: int = 4 << 20, block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``n_words, spans, items``: spans are [first, end) in words.

    The benchmark is searched for in blocks of about ``block_bytes`` of text, one pass over ``docs`` each; passes are
    written out in between, so that only one block is in memory at a time. A shard is as many whole documents as reach
    ``shard_bytes``. There is no shuffle. Null texts have no words; items without words match nothing; equal items and
    repeated rows are found alike; empty tables give no rows, or no spans. Names that are taken get underscores.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    keep = docs.columns if keep is None else keep
    added = [free_name(docs.select(*keep), x) for x in ("n_words", "spans", "items")]
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    kept = docs.select(*keep).schema
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(kept.fields)] + ["t string", "n_words long", "spans array<array<int>>", "items array<string>"])
    now = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"), F.lit(None).cast("long").alias("n_words"), F.lit(None).cast("array<array<int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"))
    before = None
    for k in range(blocks):
        rows = benchmark.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).select("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(sorted((str(r[0]), r[1] or "") for r in rows))
        now = now.mapInArrow(_pass(shared, len(keep), size, shard_bytes), schema)
        if k + 1 < blocks:
            now = staged(now, "decontamination-pass")
            shared.unpersist()
            if before is not None:
                drop_staged(before)
            before = now
    return now.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[F.col(x).alias(y) for x, y in zip(("n_words", "spans", "items"), added)])


def _pass(shared, width: int, size: int, shard_bytes: int):
    def run(batches):
        phrases = Phrases(shared.value, size)
        ids: defaultdict[bytes, int] = defaultdict(count(1).__next__)
        held, docs, held_bytes = [], [], 0

        def flush():
            found = iter(phrases.match(docs, ids))
            lengths = iter([len(d) for d in docs])
            for b in held:
                spans, items, n = [], [], []
                for s, i in zip(b.column(width + 2).to_pylist(), b.column(width + 3).to_pylist()):
                    a, c = next(found)
                    n.append(next(lengths))
                    spans.append(_merged(a + [tuple(x) for x in s or []]))
                    items.append(sorted({*c, *(i or [])}))
                yield pa.RecordBatch.from_arrays([*b.columns[: width + 1], pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))], names=b.schema.names)

        for b in batches:
            for x in b.column(width):
                raw = (x.as_py() or "").encode()
                words = words_of(raw)
                docs.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                held_bytes += len(raw)
            held.append(b)
            if held_bytes >= shard_bytes:
                yield from flush()
                held, docs, held_bytes = [], [], 0
                ids.clear()
                ids.default_factory = count(1).__next__
        if held:
            yield from flush()

    return run


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, items with occurring windows and a digest of their ids."""
    found = contamination(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: The rows of ``hits`` in DuckDB's SQL.
HITS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0
), bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS win FROM bi
), di AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw)
), hit AS (SELECT rid, i, n, item_id FROM (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM di) JOIN bw USING (n, win)
), cover AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid
), items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (rid) LEFT JOIN items USING (rid)
"""
