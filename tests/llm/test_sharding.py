import hashlib
import zlib
from collections import defaultdict

from pairloom.llm import sharding


def brute(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def key_of(doc_id):
    return int(hashlib.md5(("null" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def test_slots_agree_with_brute_force_and_have_no_gaps(spark, odd_docs):
    docs = odd_docs.unionByName(spark.range(3000).selectExpr("id + 100 doc_id", "cast(id % 7 as string) text"), allowMissingColumns=True)
    rows = sharding.slots(docs, 40, rows_per_range=10).collect()
    assert len(rows) == docs.count()
    assert sorted((str(r.doc_id), r.text_crc32) for r in rows) == sorted((str(r.doc_id), zlib.crc32((r.text or "").encode())) for r in docs.collect())
    slots = defaultdict(list)
    for r in rows:
        assert (r.shard, r.grown_shard) == (brute(key_of(r.doc_id), 40), brute(key_of(r.doc_id), 41))
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_assigning_keeps_clashing_columns_and_empty_tables(odd_docs, no_docs):
    out = sharding.assign_shards(odd_docs, 5)
    assert out.columns == [*odd_docs.columns, "shard_"] and out.count() == odd_docs.count()
    assert sharding.assign_shards(no_docs, 5).count() == 0 and sharding.slots(no_docs, 40).count() == 0


def test_writing_shards_keeps_every_row(spark, odd_docs, tmp_path):
    sharding.write_shards(odd_docs, 3, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd_docs.count()


def test_null_ids_and_rows_repeated_very_often(spark):
    docs = spark.range(300_000).selectExpr("cast(null as long) doc_id", "if(id < 200000, 'same', cast(id as string)) text")
    rows = sharding.slots(docs, 40, rows_per_range=500)
    one = rows.agg({"slot": "max"}).first()[0]
    assert rows.count() == rows.select("slot").distinct().count() == 300_000 and one == 299_999 and rows.select("shard").distinct().count() == 1


def test_sharded_rows_keep_their_columns(spark, odd_docs, no_docs):
    out = sharding.sharded(odd_docs, 40, rows_per_range=1)
    assert out.columns == [*odd_docs.columns, "shard_", "slot"]
    rows = out.collect()
    assert sorted(str(tuple(r)[:-2]) for r in rows) == sorted(str(tuple(r)) for r in odd_docs.collect())
    slots = defaultdict(list)
    for r in rows:
        assert r.shard_ == brute(key_of(r.doc_id), 40)
        slots[r.shard_].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded(no_docs, 40).count() == 0
