import hashlib
import random
import zlib

import pytest

from pairloom.llm import ogg


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 254, 255, 256, 4096, 65025, 70000, 300001])
def test_round_trip_and_checksum(size):
    raw = random.Random(size).randbytes(size)
    media = ogg.encode(ogg.padded(raw), len(raw))
    back = ogg.features(media)
    assert back["payload"] == ogg.padded(raw) and back["n_bytes"] == size and len(back["payload"]) % 64 == 0
    assert ogg.page_checksum(raw[:500]) == slow_checksum(raw[:500])


def test_packet_that_fills_whole_pages_goes_on_over_them():
    packets = [bytes(255 * 255), b"", b"x" * 510, bytes(3)]
    streams = ogg.demultiplex(b"".join(ogg.write_stream(packets, [1, 2, 3, 4], 9)))
    assert streams[9]["packets"] == packets and streams[9]["granule"] == 4


@pytest.mark.parametrize("harm", [lambda m: m[:-1], lambda m: m[:100] + bytes([m[100] ^ 1]) + m[101:], lambda m: b"x" + m, lambda m: m[: m.index(b"OggS", 4)] + m[m.rindex(b"OggS") :]])
def test_damage_is_found(harm):
    with pytest.raises((ValueError, KeyError)):
        ogg.features(harm(ogg.encode(bytes(range(256)) * 600, 5)))


def slow_feature(text):
    raw = ogg.padded((text or "").encode())
    ends = [min(i + 4096, len(raw)) for i in range(0, len(raw), 4096)]
    times = [e * 1_000_000 // 8000 for e in ends]
    wave = [b - 128 for b in raw]
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(wave, wave[1:]))
    lacing = sum(len(raw[i : i + 4096]) // 255 + 1 for i in range(0, len(raw), 4096))
    return (
        f"streams=2;pages={-(-lacing // 255) + 1};packets={len(ends)};first_us={times[0]};last_us={times[-1]};times_crc32={zlib.crc32(b''.join(t.to_bytes(8, 'little') for t in times))};"
        f"peak={max(map(abs, wave))};power={sum(w * w for w in wave) // len(wave)};crossings={crossings}"
    )


def test_times_come_from_granule_positions():
    packets = [bytes(n) for n in (10, 70_000, 3, 255, 1, 40_000)]
    ends, at = [], 0
    for p in packets:
        at += len(p)
        ends.append(at)
    stream = ogg.demultiplex(b"".join(ogg.write_stream(packets, ends, 9)))[9]
    assert ogg.packet_ends(stream).tolist() == ends and stream["pages"] > 1
    with pytest.raises(ValueError, match="disagree"):
        ogg.packet_ends(ogg.demultiplex(b"".join(ogg.write_stream(packets, [e + 1 for e in ends], 9)))[9])


def test_a_stream_without_its_last_page_is_refused():
    pages = ogg.write_stream([bytes(70_000), bytes(70_000)], [70_000, 140_000], 9)
    assert len(pages) > 2
    with pytest.raises(ValueError):
        ogg.demultiplex(b"".join(pages[:-1]))


def test_columns(odd_docs, no_docs):
    rows = {}
    for r in ogg.media_features(ogg.with_media(odd_docs)).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) == odd_docs.count()
    for d in odd_docs.collect():
        raw = ogg.padded((d.text or "").encode())
        want = len((d.text or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), slow_feature(d.text)
        assert any((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == want for r in rows[d.doc_id])
    assert ogg.media_features(ogg.with_media(no_docs)).count() == 0
