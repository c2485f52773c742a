import hashlib
import random

import pytest

from pairloom.llm import warc


def pages(spark):
    rnd = random.Random(1)
    big = ["é" + "x" * 1000, "<p>\r\n\r\nWARC/1.1\r\n" * 100, "y" * 999]
    rows = [(i, f"http://{'www.hot.org' if i % 2 else f'h{i % 7}.net:80'}/p{i % 5}?q={i}#f", rnd.choice([*big, f"own {i} " * 300])) for i in range(200)]
    rows += [(3, "http://hot.org/a b\n", rows[3][2]), (3, None, rows[3][2]), (None, "http://[bad", big[0]), (None, None, None), (500, "", ""), (501, "plain", "z" * 1000), (None, "u", "z" * 1000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Archive", __import__("pyspark").sql.functions.lit(1)).repartition(5), rows


def test_every_page_comes_back_in_order(spark, tmp_path):
    df, rows = pages(spark)
    warc.write_archives(df, str(tmp_path / "w"), archive_bytes=20_000)
    runs = warc.capture_runs(spark, str(tmp_path / "w"))
    index = warc.merged_index(runs, rows_per_range=20).collect()
    keys = [warc.order_of(tuple(r)) for r in index]
    assert keys == sorted(keys) and len(index) == len(rows) and len({r.archive for r in index}) > 5
    latest = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            latest[h] = max(i, latest.get(h, i))
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        to = latest.get(h) if latest.get(h) != i else None
        want.append((str(i), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to is not None else "response", to))
    assert sorted(map(str, want)) == sorted(str((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in index)
    assert warc.read_back(df.limit(0)).count() == 0


def test_merge_of_any_number_of_runs():
    rnd = random.Random(2)
    for k in range(9):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(12))) for _ in range(k)]
        assert list(warc.merge(runs, key=lambda x: x)) == sorted(x for r in runs for x in r)


def test_damage_is_found():
    block = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: d\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(b'hi').hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    good = head + block + b"\r\n\r\n"
    assert warc.capture(next(warc.parse(good)), "a")[2] == 1
    for bad in (good[:-1], b"x" + good, good.replace(b"hi\r", b"ho\r")):
        with pytest.raises(ValueError):
            [warc.capture(r, "a") for r in warc.parse(bad)]
