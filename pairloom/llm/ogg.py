"""Ogg containers in a binary column: written, verified, demultiplexed and read back.

A page is ``OggS``, version 0, flags, granule position, stream serial, page number, checksum, number of lacing values,
the lacing values and the body. The two streams of a file here are interleaved page by page: one holds the samples,
8 bits each, in packets; the other holds a single packet with the number of samples that belong to the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_bytes

#: The 27 bytes of a page's fixed head, little endian. Fixed value.
HEAD, HEAD_BYTES = "<4sBBqIIIB", 27
CONTINUED, FIRST, LAST = 1, 2, 4
SAMPLES, COUNTS = 1, 2

#: Each byte with its bits in reverse order.
MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """The container's CRC-32: polynomial 0x04C11DB7, most significant bit first, starting at 0, nothing inverted.

    zlib has the mirrored form of the same polynomial, so bytes and result are mirrored around it.
    """
    mirrored = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    bare = struct.pack(HEAD, b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return bare[:22] + struct.pack("<I", page_checksum(bare)) + bare[26:]


def write_stream(packets: list[bytes], granules: list[int], serial: int) -> list[bytes]:
    """The pages of one logical stream. A page's granule position is that of the last packet that ends on it, -1 if none does."""
    lacing, bodies = bytearray(), []
    ends: list[tuple[int, int]] = []  # (index of the last lacing value of a packet, granule)
    for packet, granule in zip(packets, granules, strict=True):
        lacing += b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        bodies.append(packet)
        ends.append((len(lacing) - 1, granule))
    data, at, done, pages = b"".join(bodies), 0, 0, []
    for start in range(0, len(lacing), 255):
        values = bytes(lacing[start : start + 255])
        granule = -1
        while done < len(ends) and ends[done][0] < start + len(values):
            granule = ends[done][1]
            done += 1
        size = sum(values)
        flags = (CONTINUED if start and lacing[start - 1] == 255 else 0) | (0 if start else FIRST) | (LAST if start + 255 >= len(lacing) else 0)
        pages.append(_page(flags, granule, serial, start // 255, values, data[at : at + size]))
        at += size
    return pages


def encode(payload: bytes, n_bytes: int, packet_bytes: int = 4096) -> bytes:
    """An Ogg file with the payload's bytes as samples and, in a second stream, how many of them are no padding."""
    cuts = range(0, len(payload), packet_bytes)
    samples = write_stream([payload[i : i + packet_bytes] for i in cuts], [min(i + packet_bytes, len(payload)) for i in cuts], SAMPLES)
    counts = write_stream([struct.pack("<q", n_bytes)], [0], COUNTS)
    return b"".join([samples[0], counts[0], *samples[1:]])


def read_pages(media: bytes) -> Iterator[tuple[int, int, int, int, memoryview, memoryview]]:
    """(flags, granule, serial, number, lacing, body) of each page; ValueError at a wrong sign, checksum or end."""
    view, at = memoryview(media), 0
    while at < len(media):
        if len(media) - at < HEAD_BYTES:
            raise ValueError("a page's head is cut off")
        sign, version, flags, granule, serial, number, crc, n = struct.unpack_from(HEAD, media, at)
        if sign != b"OggS" or version:
            raise ValueError("no page starts here")
        lacing = view[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if end > len(media):
            raise ValueError("a page's body is cut off")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError("a page's checksum is wrong")
        yield flags, granule, serial, number, lacing, view[at + 27 + n : end]
        at = end


def demultiplex(media: bytes) -> dict[int, dict]:
    """Each logical stream: its ``packets``, put together again from lacing values, ``pages``, last ``granule`` and ``marks``.

    A mark is (packets ended so far, granule position) of a page on which a packet ends. A stream must begin and end with
    its first and last page, and no page may follow the last.
    """
    streams: dict[int, dict] = {}
    for flags, granule, serial, number, lacing, body in read_pages(media):
        s = streams.setdefault(serial, {"packets": [], "pages": 0, "granule": 0, "open": [], "marks": [], "ended": False})
        if s["ended"] or number != s["pages"] or bool(flags & CONTINUED) != bool(s["open"]) or bool(flags & FIRST) != (number == 0):
            raise ValueError("a page is missing or out of order")
        at = 0
        run = 0
        for value in lacing:
            run += value
            if value < 255:
                s["open"].append(body[at : at + run])
                s["packets"].append(b"".join(s["open"]))
                s["open"], at, run = [], at + run, 0
        if run or (len(lacing) and lacing[-1] == 255):
            s["open"].append(body[at : at + run])
        s["pages"] += 1
        s["ended"] = bool(flags & LAST)
        if granule >= 0:
            s["granule"] = granule
            s["marks"].append((len(s["packets"]), granule))
    if any(s["open"] for s in streams.values()):
        raise ValueError("a packet has no end")
    if not all(s["ended"] for s in streams.values()):
        raise ValueError("a stream's last page is missing")
    return streams


def packet_ends(stream: dict) -> np.ndarray:
    """The granule position at which each packet of 8-bit samples ends.

    A page states that of the last packet that ends on it; those before it on the page end as many samples earlier as come
    after them. ValueError if a packet's end doesn't follow that of the packet before by its length.
    """
    lengths = np.fromiter(map(len, stream["packets"]), np.int64, len(stream["packets"]))
    ends = np.empty(len(lengths), np.int64)
    done = 0
    for upto, granule in stream["marks"]:
        part = lengths[done:upto]
        ends[done:upto] = granule - (part.sum() - np.cumsum(part))
        done = upto
    if done != len(lengths) or (np.diff(ends, prepend=0) != lengths).any():
        raise ValueError("granule positions and samples disagree")
    return ends


def features(media: bytes, rate: int = 8000) -> dict:
    """Payload and figures of a file that ``encode`` wrote, all from the stored bytes.

    Times are of packets' ends in microseconds, from granule positions: the first and last, and a checksum of all.
    """
    streams = demultiplex(media)
    payload = b"".join(streams[SAMPLES]["packets"])
    (n_bytes,) = struct.unpack("<q", streams[COUNTS]["packets"][0])
    times = packet_ends(streams[SAMPLES]) * 1_000_000 // rate
    if streams[SAMPLES]["granule"] != len(payload) or not 0 <= n_bytes <= len(payload):
        raise ValueError("granule positions and samples disagree")
    wave = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((wave[1:] >= 0) != (wave[:-1] >= 0)))
    level = sum(int((w * w).sum()) for i in range(0, len(wave), 1 << 20) for w in [wave[i : i + (1 << 20)].astype(np.int64)]) // len(wave)
    feature = (
        f"streams={len(streams)};pages={sum(s['pages'] for s in streams.values())};packets={len(times)};first_us={times[0]};last_us={times[-1]};"
        f"times_crc32={zlib.crc32(times.astype('<i8').tobytes())};peak={int(np.abs(wave).max())};power={level};crossings={crossings}"
    )
    return {"n_bytes": n_bytes, "payload": payload, "feature": feature}


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def with_media(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id`` and ``media``: each whole text as an Ogg file. A null text is an empty one: 64 samples of 0."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            media = [encode(padded(raw := x.as_py()), len(raw)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    source = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("raw"))
    return source.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Reads a column of Ogg files back: sizes, digests and features of each row; a damaged file raises ValueError.

    Null and empty texts were stored as 64 samples of 0; equal texts, repeated rows too, have equal values; an empty table
    gives no rows. Whole files pass through a task one at a time.
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for x in b.column(1):
                f = features(stored := x.as_py())
                p = f["payload"]
                rows.append((f["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f["feature"]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return media.select("doc_id", "media").mapInArrow(run, schema)
