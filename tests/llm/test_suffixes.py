import hashlib
import random
from collections import Counter

import numpy as np

from pairloom.llm import suffixes


def brute(rows, length):
    seen = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, r in raws:
        seen.update(r[a : a + length] for a in range(len(r) - length + 1))
    for i, r in raws:
        gone = np.zeros(len(r), bool)
        for a in range(len(r) - length + 1):
            if seen[r[a : a + length]] > 1:
                gone[a : a + length] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(r) else 0
        yield str(i), len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def corpus(seed):
    rnd = random.Random(seed)
    some = lambda n: "".join(rnd.choice("abcdé ") for _ in range(n))
    passages = [some(n) for n in (150, 195, 200, 201, 260, 900)]
    rows = [(i, some(rnd.randrange(700))) for i in range(30)]
    rows += [(100 + i, some(rnd.randrange(90)) + rnd.choice(passages) + some(rnd.randrange(90)) + rnd.choice(passages)) for i in range(60)]
    rows += [(200, "a" * 3000), (201, "ab" * 500), (202, "xyz" * 66 + "xy"), (203, "xyz" * 66 + "xyz"), (208, "pqr" * 80), (209, some(40) + "uvwst" * 45 + some(30)), (210, some(99) + "0123456789" * 21 + some(80)), (204, None), (205, ""), (206, rows[3][1]), (207, rows[3][1])]
    return rows + [rows[40], rows[40], (None, rows[41][1]), (None, rows[41][1]), (None, None)]


def test_agrees_with_brute_force(spark, monkeypatch):
    for seed, crowd in ((1, 1 << 40), (1, 500), (1, 1), (2, 5)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        whole = suffixes.repeats
        monkeypatch.setattr(suffixes, "repeats", lambda d, crowd=crowd: whole(d, crowd=crowd))
        got = sorted((str(r.doc_id), *r[1:]) for r in suffixes.removals(docs).collect())
        monkeypatch.setattr(suffixes, "repeats", whole)
        assert got == sorted(brute(rows, 200))


def test_sort_orders_suffixes_and_marks_equal_ones():
    rnd = random.Random(3)
    for alphabet, length in ((b"ab", 24), (b"abc", 40), (b"a", 64), (bytes(range(256)), 50)):
        block = bytes(rnd.choice(alphabet) for _ in range(300))
        data = block + bytes(rnd.choice(alphabet) for _ in range(200)) + block + block[:100]
        places = np.arange(len(data) - length + 1)
        ordered, same = suffixes.deep_shallow_sort(data, places, length)
        texts = [data[p : p + length] for p in ordered.tolist()]
        assert texts == sorted(data[p : p + length] for p in places.tolist())
        assert same.tolist() == [i > 0 and texts[i] == texts[i - 1] for i in range(len(texts))]


def test_odd_rows(odd_docs, no_docs):
    rows = suffixes.removals(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.n_removed for r in rows if r.doc_id in (5, 6)} == {300_000}
    assert suffixes.removals(no_docs).count() == 0


def test_long_texts_are_worked_on_in_pieces(spark, monkeypatch):
    rows = corpus(4) + [(300, "z" + corpus(5)[-5][1] if corpus(5)[-5][1] else "z"), (301, "".join(t or "" for _, t in corpus(6)[:30]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    got = sorted((str(r.doc_id), *r[1:]) for r in suffixes.removals(docs).collect())
    assert got == sorted(brute(rows, 200))


def test_pieces_hold_each_window_once(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 50)
    for sizes in ([0, 10, 3, 171, 5], [9] * 20, [51, 50, 49, 0], [0, 0], [100, 1, 200]):
        offsets = np.concatenate([[7], 7 + np.cumsum(sizes)])
        seen = Counter()
        for at, ends, begin, base in suffixes._pieces(offsets, 9):
            for k, (a, z) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                assert begin + a == offsets[at + k] + base and begin + z <= offsets[at + k + 1] and z <= 50 + 8
                seen.update((at + k, base + w) for w in range(z - a - 8))
        assert seen == Counter((k, w) for k, n in enumerate(sizes) for w in range(n - 8))


def test_a_text_of_20_mb(spark):
    half = "".join(random.Random(9).choices("abcdefgh ", k=10_000_000))
    docs = spark.createDataFrame([(1, half + half[:500]), (2, half[-300:] + "!")], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.removals(docs).collect()}
    assert got == {1: (10_000_500, 1300), 2: (301, 300)}
