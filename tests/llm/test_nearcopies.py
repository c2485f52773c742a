import random

import numpy as np

import corpus_pipeline
from pairloom.llm import nearcopies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def word_sets(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_groups(texts):
    """Groups of places by every pair."""
    sets, up = [word_sets(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def texts_with_copies(seed, n):
    """Texts of which many are copies of others with some words changed, and which share a long line."""
    rnd = random.Random(seed)
    some = lambda k: [f"w{rnd.randrange(3000)}" for _ in range(k)]
    line, texts = some(30), [[], some(3), some(5)]
    for _ in range(n):
        t = list(rnd.choice(texts)) if rnd.random() < 0.7 else some(rnd.choice([4, 7, 40, 150])) + line * rnd.randrange(2)
        for _ in range(rnd.randrange(5)):
            if t:
                t[rnd.randrange(len(t))] = f"w{rnd.randrange(3000)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


def test_keeps_the_first_of_each_group(spark):
    texts = texts_with_copies(3, 300)
    root = slow_groups(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS).repartition(5)
    kept = sorted(r.doc_id for r in nearcopies.one_of_each(docs).collect())
    assert kept == sorted(set(root)) and 20 < len(kept) < 250


def test_stage_finds_copies_of_more_than_three_bits(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    root = slow_groups([r.text for r in rows])
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()}
    assert kept == {rows[i].doc_id for i in set(root)}
    assert len(kept) == 187  # op8's rule keeps 189


def test_bitmaps_rule_out_no_similar_pair():
    rnd = np.random.default_rng(1)
    out = 0
    for m in (1, 5, 40, 300, 5000):
        for share in (0.0, 0.3, 0.7, 0.79, 0.81, 0.9, 1.0):
            a = np.unique(rnd.integers(0, 1 << 62, m).astype(np.uint64))
            b = np.unique(np.concatenate([a[: round(len(a) * share)], rnd.integers(0, 1 << 62, round(len(a) * (1 - share) * rnd.choice([0.2, 1, 2]))).astype(np.uint64)]))
            maybe = nearcopies.may_be_similar(nearcopies.bitmap(a), len(a), nearcopies.bitmap(b), len(b))
            assert maybe or not nearcopies.similar(a, b)
            out += not maybe
    assert out > 15


def test_odd_rows(odd_docs, no_docs):
    kept = nearcopies.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = odd_docs.collect()
    assert kept.count() == len(set(slow_groups([r.text for r in rows])))
    assert nearcopies.one_of_each(no_docs).count() == 0
