import re
from collections import defaultdict

from pairloom.llm import mixing


def level(sizes, ceiling=3):
    """Targets by resharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= ceiling * sizes[s]:
                left += target[s] - ceiling * sizes[s]
                target[s] = ceiling * sizes[s]
                open_.remove(s)
    return target


def test_targets_and_taken_words(spark, odd_docs):
    many = spark.range(4000).selectExpr("id + 100 doc_id", "repeat('w ', cast(1 + id * 7919 % 200 as int)) text", "concat('s', if(id % 3 = 0, 0, id % 17)) source")
    docs = odd_docs.unionByName(many, allowMissingColumns=True)
    rows = mixing.taken_words(docs, block=16).collect()
    assert len(rows) == docs.count()
    texts = docs.collect()
    sizes = defaultdict(int)
    for d in texts:
        sizes[d.source] += len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
    want = level(sizes)
    by_target, taken = {round(t, 6) for t in want.values()}, defaultdict(int)
    for r in rows:
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size and round(r.target, 6) in by_target
        taken[round(r.target, 6), r.source_size] += r.taken
    for s, t in want.items():
        most = max(len(re.findall(r"\S+", d.text or "")) for d in texts if d.source == s)
        assert abs(taken[round(t, 6), sizes[s]] - t) <= max(1, most)
    assert sorted(map(str, mixing.taken_words(docs.repartition(3), block=16).collect())) == sorted(map(str, rows))


def test_mix_repeats_rows(spark, odd_docs, no_docs):
    out = mixing.mix(odd_docs)
    assert out.columns == odd_docs.columns
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in odd_docs.collect()}
    assert mixing.mix(no_docs).count() == 0 and mixing.taken_words(no_docs).count() == 0


def test_every_row_has_its_expectation(spark):
    """Over 200 sources alike, the mean copies of the document of each size come within four standard errors."""
    docs = spark.range(600 * 8).selectExpr("id doc_id", "repeat('w ', cast(1 + id % 8 as int)) text", "concat('s', lpad(cast(floor(id / 8) as string), 3, '0')) source")
    sums, expected, n = defaultdict(int), {}, defaultdict(int)
    for r in mixing.copies(mixing.sized_rows(docs), block=4).collect():
        key = r.size, round(r.target, 6)
        sums[key] += r.total
        n[key] += 1
        expected[key] = r.target / r.source_size
        assert r.total in (int(expected[key]), int(expected[key]) + 1)
    assert len(n) == 24 and set(n.values()) == {200}
    for key, e in expected.items():
        part = e % 1
        assert abs(sums[key] / 200 - e) <= 4 * (part * (1 - part) / 200) ** 0.5 + 1e-9


def test_a_row_repeated_very_often(spark):
    docs = spark.range(300_000).selectExpr("cast(null as long) doc_id", "'' text", "'a' source").unionByName(spark.createDataFrame([(1, "w w", "a")], "doc_id long, text string, source string"))
    rows = mixing.taken_words(docs)
    assert rows.count() == 300_001 and rows.filter("doc_id is null").agg({"taken": "sum"}).first()[0] == 0


def test_equal_rows_share_their_copies(spark):
    same = [(None, "w w w", "a", k % 2) for k in range(7)] + [(None, "v v v", "a", 0), (5, "x", "b", 0), (5, "x y", "b", 0)]
    docs = spark.createDataFrame(same, "doc_id long, text string, source string, `plan_n` int")
    taken = sum(r.taken for r in mixing.taken_words(docs).collect())
    out = mixing.mix(docs).collect()
    assert sum(len(r.text.split()) for r in out) == taken and {tuple(r) for r in out} <= set(same)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(4)).collect()))


def test_names_that_clash_with_the_plan(spark):
    docs = spark.createDataFrame([(1, "w w", "a", 1, 2, 3, 4)], "doc_id long, text string, source string, __id int, mix_unit int, plan_doc_id int, _range int")
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() >= 1
