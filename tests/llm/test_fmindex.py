import hashlib
import random
import re

import numpy as np

from pairloom.llm import fmindex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, phrase in items:
            p = words(phrase)
            for i in range(max(1, len(p) - 9) if p else 0):
                win = p[i : i + 10]
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit.update(range(a, a + len(win)))
                        found.add(str(item))
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def corpus(seed, short):
    rnd = random.Random(seed)
    vocab = ["été", "a", "b", "the", "x1", "zz", "Q", "longword", "mid", "end"]
    some = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, some(rnd.choice([3, 7, 12, 25] if short else [15, 30]))) for i in range(12)] + [(99, ""), (100, None), (101, " ,. ")]
    docs = [(i, some(rnd.randrange(60))) for i in range(40)]
    for i in range(30):
        docs.append((200 + i, f"{some(4)}, {(rnd.choice(items)[1] or '').replace(' ', '-')}! {some(5)}"))
    return docs + [(300, None), (301, ""), (302, items[0][1]), (302, items[0][1])], items


def test_agrees_with_brute_force(spark):
    for seed, short in ((1, True), (2, False), (3, True)):
        docs, items = corpus(seed, short)
        d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
        b = spark.createDataFrame(items, "item_id long, text string")
        got = sorted(map(tuple, fmindex.hits(d, b).collect()))
        assert got == sorted(brute(docs, items))
        blocks = fmindex.contamination(d, b, keep=["doc_id"], block_bytes=100, shard_bytes=500).collect()
        assert sorted((r.doc_id, sum(y - x for x, y in r.spans), len(r["items"])) for r in blocks) == sorted((g[0], g[2], g[3]) for g in got)


def test_suffix_array_orders_suffixes():
    rnd = random.Random(5)
    for alphabet, runs in ((1, [30, 1, 0, 30]), (2, [50, 7, 50]), (40, [200, 200, 3])):
        text = [x for n in runs for x in [*(rnd.randrange(1, alphabet + 1) for _ in range(n)), 0]]
        place = {}
        for i, x in enumerate(text):
            place[i] = len(place) if x == 0 else None
        key = lambda i: [(0, j) if text[j] == 0 else (1, text[j]) for j in range(i, len(text))]  # noqa: B023, E731
        assert fmindex.suffix_array(np.array(text, np.int32)).tolist() == sorted(range(len(text)), key=key)


def test_wavelet_ranks_and_access():
    s = np.random.default_rng(0).integers(0, 37, 1000)
    tree = fmindex.WaveletTree(s, 6)
    ends, symbols = np.arange(1001), np.arange(1001) % 37
    assert (tree.ranks(symbols, ends) == [np.count_nonzero(s[:e] == c) for e, c in zip(ends, symbols)]).all()
    got, before = tree.access(np.arange(1000))
    assert (got == s).all() and (before == [np.count_nonzero(s[:e] == s[e]) for e in range(1000)]).all()


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "sat on the mat")], "item_id long, text string")
    out = fmindex.contamination(odd_docs, bench).collect()
    assert len(out) == odd_docs.count() and sum(len(r.spans) for r in out) == 2
    assert fmindex.cut("The cat SAT on: the mat, and", [(2, 6)]) == "The cat , and"
    assert fmindex.hits(no_docs, bench).count() == 0 and fmindex.hits(odd_docs, bench.limit(0)).filter("contaminated").count() == 0
