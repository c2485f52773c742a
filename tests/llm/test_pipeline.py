import re
import shutil
from collections import Counter, defaultdict

import corpus_pipeline
from test_mixing import level
from test_nearcopies import slow_groups
from test_sharding import brute, key_of

from pairloom.llm import fmindex, langid
from pairloom.llm.common import staged


def test_each_stage_does_its_part(spark, tmp_path):
    shutil.copytree("/root/testdata/sf0.001", tmp_path / "in")
    sf_dir = str(tmp_path / "in")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.union(docs.limit(5)).union(spark.createDataFrame([(900_000, None, None, None, None), (900_001, "", None, "s", 0), (None, "12 !", "en", None, 4)], docs.schema))
    columns = docs.columns
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    outs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(staged(stage(spark, outs[-1], sf_dir), "t"))
        if name != "sharding":
            assert outs[-1].columns == columns
    told = langid.identify(docs, langid.fit(docs), keep=["doc_id"])
    assert outs[1].count() == told.filter("not lang_rejected").count() >= 0.9 * 200
    rows = sorted(outs[1].collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert outs[2].count() == len(set(slow_groups([r.text for r in rows])))
    hit = fmindex.hits(outs[2], bench).filter("contaminated")
    assert outs[3].count() == outs[2].count() - hit.count() and outs[3].join(hit, "doc_id").count() == 0
    sizes, taken = defaultdict(int), defaultdict(int)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in outs[3].collect():
        sizes[r.source] += count(r.text)
    mixed = outs[4].collect()
    assert {tuple(r) for r in mixed} <= {tuple(r) for r in outs[3].collect()}
    for r in mixed:
        taken[r.source] += count(r.text)
    largest = defaultdict(int)
    for r in outs[3].collect():
        largest[r.source] = max(largest[r.source], count(r.text))
    for source, target in level(sizes).items():
        assert abs(taken[source] - target) <= max(1, largest[source])
    assert outs[5].columns == [*columns, "shard", "slot"]
    placed = outs[5].collect()
    assert Counter(tuple(r)[:-2] for r in placed) == Counter(map(tuple, mixed))
    slots = defaultdict(list)
    for r in placed:
        assert r.shard == brute(key_of(r.doc_id), 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language id", "near duplicates", "decontamination", "mixing", "sharding"]


def test_empty_documents(spark, tmp_path):
    shutil.copytree("/root/testdata/sf0.001", tmp_path / "in")
    docs = spark.read.parquet(str(tmp_path / "in/documents.parquet")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path / "in")), "t")
    assert docs.count() == 0
