import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from pairloom.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets_of(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    return len(w), Counter(zlib.crc32(r.encode()) % 10000 for r in runs)


def brute(docs, items):
    found = [(i, *buckets_of(t)) for i, t in docs]
    s, t = sum((c for _, _, c in found), Counter()), sum((buckets_of(x)[1] for _, x in items), Counter())
    all_s, all_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    rows = []
    for i, n, c in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items())
        rows.append([i, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    best = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = 5 * len(best) // 100
    out = [(*r[:4], k + 1) for k, r in enumerate(best[:drawn])] + [(*r[:4], None) for r in best[drawn:]]
    return out + [(*r[:4], None) for r in rows if r[4] < 20]


def corpus(seed, n=400):
    rnd = random.Random(seed)
    vocab = ["été", "a", "B", "the", "x1", "zz", *(f"w{i}" for i in range(60))]
    some = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, some(30)) for i in range(9)] + [(20, None), (21, "")]
    docs = [(rnd.randrange(-50, 5000), some(rnd.randrange(45))) for _ in range(n)]
    docs += [(1, some(25))] * 40 + [(None, some(30)), (None, some(30)), (2, None), (3, ""), (4, " ,. "), (6, "one"), (7, "one two")]
    docs += [(10_000 + i, items[0][1]) for i in range(60)]
    return docs, items


def plain(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize("seed,range_rows", [(1, 100_000), (2, 20), (3, 1)])
def test_agrees_with_brute_force(spark, monkeypatch, seed, range_rows):
    docs, items = corpus(seed)
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(resampling.ranked, "__defaults__", (range_rows,))
    got = resampling.weighed(d, b).collect()
    assert plain(got) == plain(brute(docs, items))


def test_a_row_that_is_most_of_the_table_is_drawn_in_part(spark):
    rows = [(5, 30, 87, 10, 100)] * 700 + [(i, 30, 87, 10, 90 + i % 20) for i in range(300)]
    df = resampling.staged(spark.createDataFrame(rows, "id long, n_words long, n_features long, weight long, score long"), "test-scores")
    for drawn in (0, 1, 160, 500, 999, 1000):
        got = resampling.ranked(df, drawn, 50).collect()
        order = sorted(rows, key=lambda r: (-r[4], r[0]))
        assert sorted((r.rank, r.id, r.score) for r in got if r.rank) == [(k + 1, r[0], r[4]) for k, r in enumerate(order[:drawn])]
        assert sorted(tuple(r)[:5] for r in got) == sorted(rows)


def test_features_of_a_text_in_parts(monkeypatch):
    text = ("Ab cd-é " * 50 + "end " + "x" * 300 + " a").encode()
    whole = Counter(resampling.features(text, 10000).__next__()[1].tolist())
    real = resampling.word_lists
    for most in (1, 10, 17, 100):
        monkeypatch.setattr(resampling, "word_lists", lambda raw, most=most: real(raw, most))
        assert sum((Counter(f.tolist()) for _, f in resampling.features(text, 10000)), Counter()) == whole == buckets_of(text.decode())[1]


def test_tournament_merges_any_number_of_runs():
    rnd = random.Random(3)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rnd.randrange(30), i) for _ in range(rnd.randrange(7))) for i in range(k)]
        merged = resampling.Tournament([iter(r) for r in runs], key=lambda r: r)
        every = sorted(x for r in runs for x in r)
        head = [x for x, _ in zip(merged, range(4))]
        assert head == every[:4] or len(every) < 4
        merged = resampling.Tournament([iter(r) for r in runs], key=lambda r: r)
        assert list(merged) == every


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "cat mat word", 3)], "item_id long, text string, doc_id int")
    got = resampling.weighed(odd_docs, bench).collect()
    assert len(got) == odd_docs.count() and all(r.rank is None for r in got) and {r.n_features for r in got if r.doc_id == 6} == {3 * 60_000 - 3}
    assert resampling.weighed(no_docs, bench).count() == 0 and resampling.weighed(odd_docs, bench.limit(0)).count() == len(got)
    names = odd_docs.withColumn("doc_id", resampling.F.concat(resampling.F.lit("n"), "doc_id"))
    rows = resampling.resampled(names, bench, percent=100, least_words=1).filter("rank is not null").collect()
    assert sorted(r.rank for r in rows) == list(range(1, len(rows) + 1)) and len(rows) > 5
