"""Ranked lexical search over an inverted index in shards.

A shard is as many whole documents as reach a number of bytes. Its documents are numbered by ascending id, and each of its
terms has compressed postings: gaps of numbers and frequencies as variable-length bytes. A query walks a shard document
at a time: a heap over the heads of its terms' postings gives the next document, a bounded heap keeps the best. Terms
whose largest possible scores together can't lift a document into it aren't walked but looked up. The best of all shards
are merged over tasks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, drop_staged, staged
from .fmindex import FOLD

#: What is no term's character, A-Z being lower-cased before.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SHARD = "ids array<{id}>, lengths array<long>, terms array<binary>, dfs array<long>, offsets array<long>, postings binary"


def word_lists(raw: bytes, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in order, as lists of about ``most`` bytes of text: a long text's words are never all held."""
    folded = raw.translate(FOLD)
    at = 0
    while at < len(folded):
        end = at + most
        if end < len(folded):
            end = folded.find(b" ", end)
            end = len(folded) if end < 0 else end
        if words := folded[at:end].split():
            yield words
        at = end


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**35 as variable-length bytes, seven bits each with a flag that more follow; and where each begins."""
    v = values.astype(np.int64)
    size = 1 + sum((v >> (7 * b) > 0).astype(np.int64) for b in range(1, 5))
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for b in range(5):
        has = size > b
        out[begin[has] + b] = ((v[has] >> (7 * b)) & 127) | ((size[has] > b + 1) << 7)
    return out, begin


def unpacked(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    begin = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = (raw[begin] & 127).astype(np.int64)
    for b in range(1, 5):
        has = np.flatnonzero(last - begin >= b)
        if not len(has):
            break
        out[has] |= (raw[begin[has] + b].astype(np.int64) & 127) << (7 * b)
    return out


def _decoded(raw: np.ndarray, offsets: np.ndarray, dfs: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents and frequencies of the terms ``which``, one after another, and where each term's end."""
    size = offsets[which + 1] - offsets[which]
    take = np.repeat(offsets[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    both = unpacked(raw[take])
    gap, tf = both[::2], both[1::2]
    ends = np.cumsum(dfs[which])
    run = np.cumsum(gap)
    before = np.concatenate([[0], run[ends[:-1] - 1]]) if len(ends) else ends
    return run - np.repeat(before, dfs[which]), tf, ends


def _shard(ids: pa.Array, lengths: list[int], owners: list[np.ndarray], codes: list[np.ndarray], terms: list[bytes]) -> dict:
    """The index of a shard. Documents come as they were read; owners are their places, codes their words' numbers."""
    order = pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_end").to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    key, tf = np.unique(np.concatenate(codes) * np.int64(len(order)) + number[np.concatenate(owners)], return_counts=True)
    term, doc = key // len(order), key % len(order)
    new = np.concatenate([[True], term[1:] != term[:-1]])
    first = np.flatnonzero(new)
    gap = np.diff(doc, prepend=0)
    gap[first] = doc[first]
    raw, begin = packed(np.stack([gap, tf], 1).ravel())
    return {"ids": ids.take(pa.array(order)).to_pylist(), "lengths": np.array(lengths)[order].tolist(), "terms": terms,
            "dfs": np.diff(np.append(first, len(term))).tolist(), "offsets": np.append(begin[2 * first], len(raw)).tolist(), "postings": raw.tobytes()}


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 4 << 20) -> DataFrame:
    """One row a shard, without a shuffle: ``ids, lengths`` of its documents, ``terms, dfs, offsets, postings``.

    Null texts and texts without a term aren't in the index; repeated rows are documents of their own; null ids sort
    last. A longer text than ``shard_bytes`` fills a shard alone. An empty table has no shards.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches):
        codes_of: defaultdict[bytes, int] = defaultdict()
        codes_of.default_factory = codes_of.__len__
        ids, lengths, owners, codes, size, schema = [], [], [], [], 0, None

        def flush():
            made = _shard(pa.concat_arrays(ids), lengths, owners, codes, list(codes_of))
            types = [pa.list_(ids[0].type), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made.values(), types)], names=list(made))

        for b in batches:
            names, texts = b.column(0), b.column(1)
            for i in range(len(b)):
                raw = texts[i].as_py() or b""
                n = 0
                for words in word_lists(raw):
                    codes.append(np.fromiter(map(codes_of.__getitem__, words), np.int32, len(words)))
                    owners.append(np.full(len(words), len(lengths), np.int32))
                    n += len(words)
                if n:
                    ids.append(names.slice(i, 1))
                    lengths.append(n)
                    size += len(raw)
                if size >= shard_bytes:
                    yield flush()
                    codes_of.clear()
                    ids, lengths, owners, codes, size = [], [], [], [], 0
        if lengths:
            yield flush()

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, SHARD.format(id=kind.simpleString()))


def walk(lists: list[tuple[int, int, list[int], list[int]]], k: int, least: int = 1) -> list[tuple[int, int]]:
    """The ``k`` best (score, document) of the lists, best first, equal scores by ascending document.

    A list is (largest gain, factor, ascending documents, their gains); a score sums factor x gain. Only scores of
    ``least`` or more count.
    """
    lists = sorted(lists)
    reach, total = [], 0  # what the first i + 1 lists can add to a score
    for bound, *_ in lists:
        total += bound
        reach.append(total)
    best: list[tuple[int, int]] = []
    bar = max(least, 1)  # a score below it is of no use
    looked = 0  # lists before this one are looked up
    while looked < len(lists) and reach[looked] < bar:
        looked += 1
    heads = [(lists[i][2][0], i, 0) for i in range(looked, len(lists))]
    heapify(heads)
    while heads:
        doc, score = heads[0][0], 0
        while heads and heads[0][0] == doc:
            _, i, at = heads[0]
            _, factor, docs, gains = lists[i]
            score += factor * gains[at]
            at += 1
            if i >= looked and at < len(docs):
                heapreplace(heads, (docs[at], i, at))
            else:
                heappop(heads)
        for i in range(looked - 1, -1, -1):
            if score + reach[i] < bar:
                break
            _, factor, docs, gains = lists[i]
            at = bisect_left(docs, doc)
            if at < len(docs) and docs[at] == doc:
                score += factor * gains[at]
        if score < bar:
            continue
        if len(best) < k:
            heappush(best, (score, -doc))
        else:
            heapreplace(best, (score, -doc))
        if len(best) == k and best[0][0] >= bar:
            bar = best[0][0] + 1  # later documents lose a tie
            while looked < len(lists) and reach[looked] < bar:
                looked += 1
            if looked and any(i < looked for _, i, _ in heads):
                heads = [h for h in heads if h[1] >= looked]
                heapify(heads)
    return [(s, -d) for s, d in sorted(best, reverse=True)]


def _gains(tf: np.ndarray, damping: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * damping)


def _search(shared, k: int, schema: pa.Schema):
    """Walks each shard for each query of a block; a task keeps its k best of all its shards and gives them at its end."""

    def order(hit):
        score, name = hit
        return -score, name is None, name

    def run(batches):
        n_docs, n_terms, weights, queries = shared.value
        wanted = pa.array(list(weights), pa.binary())
        best: dict[int, list] = {}
        for b in batches:
            for row in range(len(b)):
                ids, lengths, terms, dfs, offsets = (b.column(c)[row].values for c in ("ids", "lengths", "terms", "dfs", "offsets"))
                raw = np.frombuffer(b.column("postings")[row].as_buffer(), np.uint8)
                damping = np.array([25 + 75 * n * n_docs // n_terms for n in lengths.to_pylist()], np.int64)
                known = pc.is_in(terms, value_set=wanted).to_numpy(zero_copy_only=False)
                which = np.flatnonzero(known)
                doc, tf, ends = _decoded(raw, offsets.to_numpy(), dfs.to_numpy(), which)
                gain = _gains(tf, damping[doc])
                here = {}
                for t, lo, hi in zip(terms.take(pa.array(which)).to_pylist(), [0, *ends.tolist()], ends.tolist()):
                    here[t] = int(gain[lo:hi].max()), doc[lo:hi].tolist(), gain[lo:hi].tolist()
                for query, counts in queries:
                    lists = [(w * here[t][0], w, here[t][1], here[t][2]) for t, n in counts.items() if t in here and (w := n * weights[t])]
                    if lists:
                        now = best.get(query, [])
                        found = [(s, ids[d].as_py()) for s, d in walk(lists, k, now[-1][0] if len(now) == k else 1)]
                        if found:
                            best[query] = sorted(now + found, key=order)[:k]
        if best:
            rows = [(q, s, i) for q, hits in best.items() for s, i in hits]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names=schema.names)

    return run


def terms_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0)), lambda t: t.cast("binary"))


def search(index: DataFrame, queries: DataFrame, k: int = 10, text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """``queries`` with ``rank, found, score``: each row's ``k`` best documents of ``index``, a written table of shards.

    Different query texts are searched for once, in blocks of about ``block_bytes`` (a longer text is a block alone), one
    pass over the index each. A query without terms, a null one too, finds nothing and gives no row; equal queries find
    alike. Ties go by ascending id, null ids last. Columns of ``queries`` may not be called rank, found or score.
    """
    spark = index.sparkSession
    bound_batches(spark)
    whole = index.agg(F.sum(F.size("lengths").cast("long")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n))).first()
    n_docs, n_terms = whole[0] or 0, whole[1] or 0
    texts = staged(queries.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("_text")).distinct().withColumn("_query", F.monotonically_increasing_id()), "lexical-queries")
    blocks = max(1, -(-(texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0) // block_bytes))
    kind = index.schema["ids"].dataType.elementType.simpleString()
    id_type = pa.schema([("q", pa.int64()), ("score", pa.int64()), ("found", _arrow(index.schema["ids"].dataType.elementType))])
    done = []
    for block in range(blocks):
        mine = texts.filter(F.pmod(F.xxhash64("_text"), F.lit(blocks)) == block)
        rows = [(r[0], Counter(map(bytes, r[1]))) for r in mine.select("_query", terms_of(F.col("_text"))).collect()]
        wanted = F.broadcast(mine.select(F.explode(terms_of(F.col("_text"))).alias("term")).distinct())  # of at most block_bytes of text
        held = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
        weights = {bytes(r[0]): r[1] for r in held.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).select("term", weight).collect()}
        shared = spark.sparkContext.broadcast((n_docs, n_terms, weights, rows))
        hits = index.mapInArrow(_search(shared, k, id_type), f"q long, score long, found {kind}")
        done.append(staged(_best(hits, k), "lexical-best"))
        shared.unpersist()
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    lists = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "found", "score"))).alias("_best"))  # k rows each
    # Few rows and many equal texts: the best come to the queries, whichever task these are in.
    return queries.join(texts.join(lists, F.col("q") == F.col("_query")).select("_text", "_best"), F.col(text_col) == F.col("_text")).select(*[queries[c] for c in queries.columns], F.explode("_best").alias("_hit")).select(*queries.columns, "_hit.rank", "_hit.found", "_hit.score")


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _best(hits: DataFrame, k: int) -> DataFrame:
    """Per query the k best of all tasks; Spark keeps k a task before the rows are dealt."""
    window = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("found").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def ranked(docs: DataFrame, benchmark: DataFrame, k: int = 10) -> DataFrame:
    """Each benchmark row's ``k`` best documents: ``item_id, rank, doc_id, score``. Repeated rows give their own."""
    index = staged(build_index(docs), "lexical-index")
    found = search(index, benchmark.select("item_id", "text"), k)
    drop_staged(index)
    return found.select("item_id", "rank", F.col("found").alias("doc_id"), "score")


#: The rows of ``ranked`` in DuckDB's SQL.
RANKED_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT row_number() OVER () AS bid, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark
), q AS (SELECT bid, term, count(*) AS qn FROM (SELECT bid, unnest(w) AS term FROM b) GROUP BY ALL
), v AS (SELECT DISTINCT term FROM q
), c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0
), p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) SEMI JOIN v USING (term) GROUP BY ALL
), t AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, c GROUP BY term, n_docs
), m AS (SELECT rid, doc_id, 25 + (75 * CAST(len(w) AS BIGINT) * n_docs) // n_terms AS damping FROM d, c WHERE len(w) > 0
), s AS (
  SELECT bid, doc_id, rid, CAST(sum(qn * weight * ((1000000000 * tf) // (1000 * tf + 8 * damping))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY ALL
), r AS (SELECT *, row_number() OVER (PARTITION BY bid ORDER BY score DESC, doc_id NULLS LAST, rid) AS place FROM s WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM r JOIN b USING (bid) WHERE place <= 10
"""
