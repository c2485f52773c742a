import random
import re

import numpy as np
import xxhash

from pairloom.llm import simhash


def slow_fingerprint(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(codes):
    up = {c: c for c in codes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in codes:
        for b in codes:
            if (a ^ b).bit_count() <= 3:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {c: root(c) for c in codes}


def near_codes(seed, n):
    rnd = random.Random(seed)
    codes = [0]
    for _ in range(n):
        c = rnd.choice(codes) if rnd.random() < 0.7 else rnd.getrandbits(64)
        for _ in range(rnd.randrange(6)):
            c ^= 1 << rnd.randrange(64)
        codes.append(c)
    return sorted(set(codes))


def test_index_finds_all_pairs_of_a_group():
    codes = np.array(near_codes(1, 400), np.uint64)
    groups = np.arange(len(codes)) % 3
    index = simhash.GrayIndex(groups, codes, fanout=4)
    got = {(int(index.codes[q]), int(index.codes[m])) for a in index.pairs(3, at_once=64) for q, m in zip(*a)}
    of = dict(zip(codes.tolist(), groups.tolist()))
    want = {frozenset((a, b)) for a in of for b in of if a != b and of[a] == of[b] and (a ^ b).bit_count() <= 3}
    assert {frozenset(p) for p in got} == want and len(got) == len(want) > 20


def test_gray_rank():
    n = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_components_agree_with_brute_force(spark):
    codes = near_codes(2, 500)
    rows = [(1000 - i, c - 2**64 if c >= 2**63 else c) for i, c in enumerate(codes)] + [(5000, codes[3] - 2**64 if codes[3] >= 2**63 else codes[3]), (None, 0)]
    got = {r.doc_id: r.component_id for r in simhash.groups_of(spark.createDataFrame(rows, "doc_id long, fp long")).collect()}
    root, least = slow_components(codes), {}
    for d, c in rows:
        if d is not None:
            least[root[c % 2**64]] = min(d, least.get(root[c % 2**64], d))
    assert got == {d: least[root[c % 2**64]] for d, c in rows}


def test_heavy_groups_are_dealt_again_and_lose_no_link(spark):
    base = 0x1234_5678_9ABC_DEF0
    rnd = random.Random(4)
    codes = near_codes(3, 200)
    for _ in range(300):  # many that agree in the lowest and the highest quarter
        c = base ^ rnd.getrandbits(32) << 16
        codes += [c, c ^ 1 << rnd.randrange(64) ^ 1 << rnd.randrange(64)]
    codes = sorted(set(codes))
    signed = [(c - 2**64 if c >= 2**63 else c,) for c in codes]
    df = spark.createDataFrame(signed, "fp long")
    edges = simhash.links(df, 3, most=20)
    assert simhash.dealt(df, 3, most=20).groupBy("k").count().agg({"count": "max"}).first()[0] < simhash.dealt(df).groupBy("k").count().agg({"count": "max"}).first()[0]
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = slow_components(codes)
    mine = {c: got.get(s, s) for c, (s,) in zip(codes, signed)}
    assert len({(mine[c], want[c]) for c in codes}) == len(set(mine.values())) == len(set(want.values()))


def test_whole_operator_on_odd_rows(odd_docs, no_docs):
    rows = simhash.groups(odd_docs).collect()
    texts = odd_docs.collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in rows) == sorted((str(d.doc_id), f"{slow_fingerprint(d.text):016x}") for d in texts)
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    fps = [slow_fingerprint(r.text) for r in kept.collect()]
    root = slow_components(sorted({slow_fingerprint(d.text) for d in texts}))
    assert len(fps) == len({root[f] for f in fps}) == len(set(root.values()))
    assert simhash.groups(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0
