"""WARC archives of pages, and the merged capture index over them.

Writing stays in Spark: a record is built by string functions and the text sink writes records one after another, on any
file system, with Spark's commit protocol. A payload that was captured before is not stored again but revisited. Reading
takes whole archives of bounded size, checks lengths and digests, and sorts each archive's captures by URL key and
timestamp: that is one run. Runs are cut by ranges of the index; each range's pieces meet in a loser tree, so that the
index is in order within and across its partitions. A hot URL or host is cut by timestamp and page like any range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, shared_dir, staged, text_bytes

#: Payloads below this size are always stored. Fixed value.
LEAST_REVISITED = 1000

#: The profile of a record whose payload has the digest of an earlier one. Fixed value.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

EPOCH = 1_704_067_200  # captures are dated by page number from here on, one second each

ENTRY = "url_key string, ts string, page_id long, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def decided(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` with ``payload_bytes, payload_digest, record_type, refers_to``.

    Of equal payloads of at least 1000 bytes, the rows with the largest page_id are responses and the others revisit it;
    a null page_id is smaller than any, and null html is an empty payload.
    """
    raw = text_bytes("html")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.octet_length(raw).cast("long").alias("payload_bytes"), F.sha1(raw).alias("payload_digest"))
    same = rows.filter(F.col("payload_bytes") >= LEAST_REVISITED).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("latest"), F.count("*").alias("n"))
    same = staged(same.filter((F.col("n") > 1) & F.col("latest").isNotNull()).drop("n"), "warc-equal")
    if same.count() <= 100_000:  # about 10 MB at most; a longer list is joined by shuffling, where hot digests are split
        same = F.broadcast(same)
    rows = rows.join(same, ["payload_digest", "payload_bytes"], "left")
    again = F.col("latest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("latest"))
    return rows.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("latest"))).drop("latest")


def records(rows: DataFrame) -> DataFrame:
    """One column with each row's WARC record, without the line end that the sink adds."""
    eol = "\r\n"
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    url = F.coalesce(F.col("url"), F.lit("about:blank"))
    url = F.when(url.rlike(r"[\x00-\x20\x7f]"), F.url_encode(url)).otherwise(url)
    when = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    size = F.col("payload_bytes").cast("string")
    again = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), size, F.lit(eol * 2))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    block_size = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("payload_bytes"))
    head = F.concat(
        F.lit(f"WARC/1.1{eol}WARC-Type: "), F.col("record_type"), F.lit(f"{eol}WARC-Record-ID: <urn:page:"), page, F.lit(f">{eol}WARC-Date: "), when,
        F.lit(f"{eol}WARC-Target-URI: "), url, F.lit(f"{eol}Content-Type: application/http; msgtype=response{eol}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(again, F.concat(F.lit(f"{eol}WARC-Profile: {PROFILE}{eol}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{eol}Content-Length: "), block_size.cast("string"), F.lit(eol * 2),
    )
    return rows.select(F.concat(head, block, F.lit(eol)).alias("record"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = 16 << 20) -> None:
    """Writes the pages as archives of about ``archive_bytes`` under ``path``; none is near the 2 GB a row can hold."""
    rows = decided(pages)
    sizes = pages.agg(F.avg(F.octet_length("html")), F.max(F.octet_length("html"))).first()
    each, most = (sizes[0] or 0) + 700, (sizes[1] or 0) + 700
    limit = max(1, int(min(archive_bytes / each, (1 << 30) / most)))
    records(rows).write.option("lineSep", "\r\n").option("maxRecordsPerFile", limit).text(path)


def url_key(url: str) -> str:
    """The URL with its host's labels reversed, so that a domain's captures are neighbours; other forms as they are."""
    try:
        parts = urlsplit(url)
        host = parts.hostname
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url
    if not host:
        return url
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def parse(archive: bytes) -> Iterator[dict]:
    """The records of an archive with offset, length, head lines and block; ValueError if one is damaged."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        lines = archive[at:end].decode().split("\r\n") if end >= 0 else [""]
        if lines[0] != "WARC/1.1":
            raise ValueError("no record starts here")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size = int(head["Content-Length"])
        block = archive[end + 4 : end + 4 + size]
        stop = end + 4 + size + 4
        if len(block) < size or archive[stop - 4 : stop] != b"\r\n\r\n":
            raise ValueError("a record has no end")
        yield {"offset": at, "length": stop - at, "head": head, "block": block}
        at = stop


def _number(urn: str | None) -> int | None:
    inside = (urn or "<urn:page:none>")[len("<urn:page:") : -1]
    return None if inside == "none" else int(inside)


def capture(record: dict, archive: str) -> tuple:
    """The index entry of a record, in the order of ENTRY; a stored payload must have the stated size and digest."""
    head = record["head"]
    http, _, payload = record["block"].partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload doesn't have its digest")
    refers = _number(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None
    return url_key(head["WARC-Target-URI"]), head["WARC-Date"], _number(head["WARC-Record-ID"]), archive, record["offset"], record["length"], size, digest, head["WARC-Type"], refers


def order_of(entry: tuple) -> tuple:
    """URL key, timestamp, page (none first), archive, offset."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[3], entry[4]


def merge(runs: list[Iterable[tuple]], key=order_of) -> Iterator[tuple]:
    """Merges sorted runs by a tree of losers: an inner node keeps the run that lost there, the winner goes on up."""
    sources = [iter(r) for r in runs]
    k = len(sources)
    end = object()
    heads: list = [next(s, end) for s in sources]
    keys: list = [None if h is end else key(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        if keys[a] is None or keys[b] is None:
            return keys[b] is None and (keys[a] is not None or a < b)
        return (keys[a], a) < (keys[b], b)

    losers = [0] * max(k, 1)

    def play(node: int) -> int:  # the winner below a node; leaves are k .. 2k-1
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        win, lose = (a, b) if beats(a, b) else (b, a)
        losers[node] = lose
        return win

    if not k:
        return
    winner = play(1) if k > 1 else 0
    while keys[winner] is not None:
        yield heads[winner]
        heads[winner] = next(sources[winner], end)
        keys[winner] = None if heads[winner] is end else key(heads[winner])
        node = (winner + k) // 2
        while node:
            if beats(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
_NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def capture_runs(spark, path: str) -> DataFrame:
    """Index entries of the archives under ``path``, each archive's in order and one archive after another."""

    def run(batches):
        for b in batches:
            for name, content in zip(*(c for c in b.columns)):
                archive = name.as_py().rsplit("/", 1)[-1]
                rows = sorted((capture(r, archive) for r in parse(content.as_py())), key=order_of)
                for i in range(0, len(rows), 5000):
                    yield _batch(rows[i : i + 5000])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ENTRY)


def merged_index(runs: DataFrame, rows_per_range: int = 100_000) -> DataFrame:
    """The entries of all runs in one order, by URL key, timestamp and page, across partitions too."""
    total = runs.count()
    parts = max(1, min(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total), -(-total // rows_per_range))

    def run(batches):
        pieces: dict[str, list[tuple]] = {}
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                pieces.setdefault(row[3], []).append(row)
        for piece in pieces.values():
            if any(order_of(a) > order_of(b) for a, b in zip(piece, piece[1:])):
                piece.sort(key=order_of)  # a shuffle may hand over the blocks of a run in another order
        out: list[tuple] = []
        for row in merge(list(pieces.values())):
            out.append(row)
            if len(out) == 5000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    order = ["url_key", "ts", F.col("page_id").asc_nulls_first(), "archive", "offset"]
    return runs.repartitionByRange(parts, *order).mapInArrow(run, ENTRY)


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes all pages, reads the archives back and gives the merged index. No pages give an empty index."""
    import uuid

    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    bound_batches(spark)  # an archive is as large as a batch may be, so they go to Python one or two at a time
    return merged_index(staged(capture_runs(spark, path), "warc-runs"))


def read_back(pages: DataFrame) -> DataFrame:
    return archived(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The rows of ``read_back`` in DuckDB's SQL.
READ_BACK_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS latest FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < latest THEN latest END AS refers_to
FROM w
"""
