import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pairloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    for item, text in items:
        found = []
        for i, bag in bags:
            m = 100 - 75 + 75 * sum(bag.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if t in bag)
            if score > 0:
                found.append((-score, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(found)[:k]):
            yield item, rank + 1, i, -s


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [*"abcdefgh", "É", "Zz", "the", "The", "x1", "naïve", *(f"w{i}" for i in range(40))]
    weights = [1 / (i + 1) for i in range(len(vocab))]
    some = lambda n: " ".join(rnd.choices(vocab, weights, k=n))
    docs = [(rnd.randrange(10**6), some(rnd.randrange(1, 40))) for _ in range(300)]
    docs += [(7_000_000 + i, docs[i % 5][1]) for i in range(60)] + [docs[3], docs[3], (None, docs[4][1]), (5, None), (6, ""), (8, " ,.- "), (9, "a " * 5000)]
    items = [(i, some(rnd.randrange(1, 30))) for i in range(25)] + [(50, None), (51, ""), (52, "nowhere to be found"), (53, docs[0][1]), (53, docs[0][1]), (None, "x1 x1 the")]
    rnd.shuffle(docs)
    return docs, items


def key(row):
    return str(row)


@pytest.mark.parametrize("seed,shard_bytes,block_bytes", [(1, 4 << 20, 4 << 20), (2, 500, 400), (3, 1, 1 << 20)])
def test_agrees_with_brute_force(spark, seed, shard_bytes, block_bytes):
    docs, items = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    index = lexical.staged(lexical.build_index(d, shard_bytes=shard_bytes), "test-index")
    got = lexical.search(index, b, block_bytes=block_bytes).select("item_id", "rank", "found", "score").collect()
    assert sorted(map(key, map(tuple, got))) == sorted(map(key, brute(docs, items)))


def test_the_query_agrees_with_brute_force(spark):
    docs, items = corpus(9)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(key, map(tuple, lexical.ranked(d, b).collect()))) == sorted(map(key, brute(docs, items)))


def test_walk_agrees_with_sums_and_keeps_ties_in_order():
    rnd = random.Random(4)
    for _ in range(300):
        lists = []
        for _ in range(rnd.randrange(1, 7)):
            docs = sorted(rnd.sample(range(40), rnd.randrange(1, 40)))
            gains = [rnd.randrange(1, 5) for _ in docs]
            f = rnd.choice([1, 1, 2, 9])
            lists.append((f * max(gains), f, docs, gains))
        score = Counter()
        for _, f, docs, gains in lists:
            for d, g in zip(docs, gains):
                score[d] += f * g
        for k, least in ((1, 1), (3, 1), (10, 6), (100, 1)):
            assert lexical.walk(lists, k, least) == sorted(((s, d) for d, s in score.items() if s >= least), key=lambda x: (-x[0], x[1]))[:k]


def test_postings_are_packed_losslessly():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1, 2**28, 2**35 - 1])
    raw, begin = lexical.packed(v)
    assert (lexical.unpacked(raw) == v).all() and begin[3] == 3 and len(lexical.unpacked(raw[:0])) == 0


def test_words_of_a_long_text_come_in_pieces():
    text = ("Ab, cd-é " * 1000 + "x" * 5000 + " end").encode()
    assert [w for part in lexical.word_lists(text, 100) for w in part] == [t.encode() for t in terms(text.decode())]


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "cat number word", "q")], "item_id long, text string, doc_id string")
    got = lexical.ranked(odd_docs, bench).collect()
    assert [r.rank for r in sorted(got)] == list(range(1, len(got) + 1)) and {r.doc_id for r in got} == {1, 6, None}
    assert lexical.ranked(no_docs, bench).count() == 0 and lexical.ranked(odd_docs, bench.limit(0)).count() == 0
    names = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y")], "doc_id string, text string")
    assert [(r.rank, r.doc_id) for r in sorted(lexical.ranked(names, spark.createDataFrame([(1, "y")], "item_id long, text string")).collect())] == [(1, "a"), (2, "b"), (3, None)]
