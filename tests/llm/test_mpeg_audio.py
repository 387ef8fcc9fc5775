"""Streams built, damaged and parsed."""

import hashlib
import random
import struct
import zlib
from fractions import Fraction

import pytest

from matchloom.llm.mpeg_audio import build, crc16, encode, feature, header_at, parse, payload, probe


@pytest.mark.parametrize("data", [b"", b"a", b"\xff" * 576, b"\xff\xfa\xb0\xc0" * 700, bytes(range(256)) * 9])
def test_round_trip(data):
    raw = build(data)
    got = parse(raw)
    want = data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
    assert payload(raw, got) == want
    assert got.table == "Info" and got.table_frames == len(got.offsets) == len(want) // 576
    assert got.seconds == Fraction(1152 * len(got.offsets), 44100)
    assert (got.wrong, got.skipped, got.resyncs) == (0, 0, 0) and got.checked == len(got.offsets)
    for sample in {0, 1151, 1152 * len(got.offsets) // 2, 1152 * len(got.offsets) - 1}:
        at, first = got.seek(sample)
        assert header_at(raw, at) and first <= sample < first + 1152


def test_resynchronises_after_junk_and_finds_damage():
    raw = build(bytes(5000))
    clean = parse(raw)
    cut = int(clean.offsets[3])
    junk = raw[:cut] + b"\xff\xfb\x90junk\xff" * 5 + raw[cut:]
    got = parse(junk)
    assert len(got.offsets) == len(clean.offsets) and got.resyncs == 1 and got.skipped == 40
    bad = bytearray(raw)
    bad[cut + 8] ^= 1
    assert parse(bytes(bad)).wrong == 1
    assert payload(bytes(bad), parse(bytes(bad))) is None


def test_other_streams():
    layer2 = bytes([0xFF, 0xFD, 0xA4, 0x00])
    size = header_at(layer2, 0).size
    assert size == 144000 * 192 // 48000
    got = parse((layer2 + bytes(size - 4)) * 3 + b"TAG" + bytes(125))
    assert len(got.offsets) == 3 and got.seconds == Fraction(3 * 1152, 48000) and got.table == ""
    half = bytes([0xFF, 0xF3, 0x80, 0x00])
    assert header_at(half, 0).samples == 576
    assert len(parse(b"").offsets) == len(parse(b"no audio \xff\xff here").offsets) == 0


def test_crc_of_known_value():
    import numpy as np

    assert crc16(np.frombuffer(b"123456789", np.uint8)[None])[0] == 0xAEE7


def plain_crc(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ b) & 1 else 0)) & 0xFFFF
    return crc


# header, bits of the allocation, and scale factor selections if everything is allocated
@pytest.mark.parametrize("head, alloc, selected", [
    ([0xFF, 0xFE, 0x80, 0xC0], 128, 0), ([0xFF, 0xFE, 0x80, 0x00], 256, 0), ([0xFF, 0xFE, 0x80, 0x50], 160, 0),
    ([0xFF, 0xFC, 0xA4, 0xC0], 88, 27), ([0xFF, 0xFC, 0xA4, 0x00], 176, 54), ([0xFF, 0xFC, 0xA0, 0xC0], 94, 30),
    ([0xFF, 0xFC, 0x20, 0xC0], 26, 8), ([0xFF, 0xFC, 0x28, 0xC0], 38, 12), ([0xFF, 0xFC, 0xA4, 0x50], 120, 54),
    ([0xFF, 0xF4, 0xA4, 0x00], 150, 60),
])
def test_checksums_of_layers_1_and_2(head, alloc, selected):
    size = header_at(bytes(head), 0).size
    for ones in (0, 1):  # nothing allocated, and everything
        covered = [ones] * alloc + [k // 2 & 1 for k in range(2 * selected * ones)]
        crc = plain_crc([b >> k & 1 for b in head[2:] for k in range(7, -1, -1)] + covered)
        bits = (covered + [1, 0] * 8)[: (len(covered) + 15) // 8 * 8]
        raw = bytes(head) + crc.to_bytes(2) + bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits) // 8 * 8, 8))
        frame = raw.ljust(size, b"\x55")[:size]
        got = parse(frame * 4)
        assert (len(got.offsets), got.checked, got.wrong) == (4, 4, 0)
        for place in (6, 5 + len(covered) // 8):
            bad = bytearray(frame * 4)
            bad[size + place] ^= 0x80
            assert parse(bytes(bad)).wrong == 1


def test_vbri_table():
    head = bytes([0xFF, 0xFB, 0x90, 0x00])
    size = header_at(head, 0).size
    vbri = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 7 * size, 6, 3, 2, 2, 2) + struct.pack(">HHH", *[size] * 3)
    got = parse((head + bytes(32) + vbri).ljust(size, b"\0") + (head + bytes(size - 4)) * 6)
    assert (got.table, got.table_frames, got.table_bytes, len(got.offsets)) == ("VBRI", 6, 7 * size, 6)
    assert got.toc_bytes == (2 * size,) * 3 and got.toc_frames == 2


def test_checks_nothing_without_checksums(spark):
    head = bytes([0xFF, 0xFD, 0xA4, 0x00])
    bad = bytes([0xFF, 0xFC, 0xA4, 0x00])
    size = header_at(head, 0).size
    rows = [(1, bytearray((head + bytes(size - 4)) * 3)), (2, bytearray((bad + bytes(size - 4)) * 3)), (3, bytearray(build(b"x")))]
    got = {r.doc_id: r.crc_ok for r in probe(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got == {1: None, 2: False, 3: True}


def test_table(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "é\n" * 3000, 0), (3, "abc", 1), (3, "abc", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media int")
    got = probe(encode(df)).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "", 2: "", None: "é\n" * 3000, 3: "abc"}[r.doc_id].encode()
        want = text.ljust(max(1, -(-len(text) // 576)) * 576, b"\xff")
        assert (r.n_bytes, r.payload_bytes) == (len(text), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-32:])
        assert r.crc_ok and r.n_frames == len(want) // 576
    assert probe(encode(df.limit(0))).count() == 0
    assert probe(spark.createDataFrame([(1, None), (2, bytearray(b"zz"))], "doc_id long, media binary")).count() == 2


def test_every_frame_can_be_sought(spark):
    slow, fast = bytes([0xFF, 0xFB, 0x50, 0x00]), bytes([0xFF, 0xFB, 0xB0, 0x00])
    frames = [(h + bytes(header_at(h, 0).size - 4)) for h in [slow, fast, fast, slow, fast] * 20]
    raw = b"".join(frames)
    row = probe(spark.createDataFrame([(1, bytearray(raw))], "doc_id long, media binary")).collect()[0]
    assert row.n_frames == 100 and row.seek_offsets == [sum(map(len, frames[:k])) for k in range(100)]


def frame(name, text, size):
    return name + size(len(text)) + bytes(2 if len(name) == 4 else 0) + text


def test_tags_of_all_versions():
    sound = build(b"x")
    sound = sound[sound.index(b"\xff\xfa") :]
    safe = lambda n: bytes(n >> s & 0x7F for s in (21, 14, 7, 0))
    big = lambda n: n.to_bytes(4)
    small = lambda n: n.to_bytes(3)

    def tag(major, body, flags=0):
        return b"ID3" + bytes([major, 0, flags]) + safe(len(body)) + body

    v22 = tag(2, frame(b"TT2", b"\0Song", small) + frame(b"TXX", b"\0key\0value", small) + b"\0" * 9)
    assert parse(v22 + sound).tags == {"TT2": "Song", "key": "value"}
    wide = "Çok".encode("utf-16")
    v23 = tag(3, (frame(b"TIT2", b"\x01" + wide, big) + frame(b"APIC", b"\xff" * 9, big)).replace(b"\xff", b"\xff\0"), 0x80)
    assert parse(v23 + sound).tags == {"TIT2": "Çok"}
    v24 = tag(4, safe(6) + b"\x01\0" + frame(b"TIT2", b"\x03\xc3\xa7", safe), 0x40)
    assert parse(v24 + sound).tags == {"TIT2": "ç"}
    v1 = b"TAG" + b"Name".ljust(30, b"\0") + b"Who".ljust(30) + bytes(30) + b"1999" + bytes(31)
    got = parse(sound + v1)
    assert got.tags == {"id3v1.title": "Name", "id3v1.artist": "Who", "id3v1.year": "1999"} and len(got.offsets) == 1 and got.skipped == 0


def test_damaged_and_foreign_streams_beside_good_ones(spark):
    def noted(raw, old, new):
        assert old in raw
        return raw.replace(old, new)

    good = build(b"hello" * 300)
    side = bytearray(good)
    side[int(parse(good).offsets[1]) + 9] ^= 4
    body = bytearray(good)
    body[int(parse(good).offsets[1]) + 100] ^= 4
    rows = {
        1: good, 2: bytes(side), 3: bytes(body), 4: noted(good, b"unit\x00576", b"unit\x00mmm"), 5: noted(good, b"unit\x00576", b"unit\x00999"), 6: noted(good, b"crc32", b"crc99"),
        7: noted(good, b"bytes\x001500", b"bytes\x00n/a0"), 8: good[:400], 9: good[: len(good) - 300], 10: b"", 11: None, 12: b"\xff" * 5000, 13: noted(good, b"bytes\x001500", b"bytes\x009999"), 14: good[200:],
    }
    got = {r.doc_id: r for r in probe(spark.createDataFrame(list(rows.items()), "doc_id long, media binary").repartition(2)).collect()}
    assert len(got) == 14 and got[1].n_bytes == 1500 and got[1].crc_ok and got[1].payload_bytes == 1728
    for k in (2, 3, 4, 5, 6, 9):
        assert got[k].payload_sha256 is None and got[k].n_bytes is None and got[k].crc_ok is False, k
    for k in (7, 13):
        assert got[k].n_bytes is None and got[k].crc_ok and got[k].payload_sha256 == got[1].payload_sha256
    assert got[10].n_frames == got[12].n_frames == 0 and got[10].duration_ms == 0 and got[12].crc_ok is None
    assert got[11].media_bytes is None and got[14].n_bytes is None


def test_any_bytes_are_parsed():
    rng = random.Random(4)
    raw = build(b"some bytes" * 200)
    for _ in range(400):
        bad = bytearray(raw)
        for _ in range(rng.randint(1, 12)):
            at = rng.randrange(rng.choice([60, 200, len(bad)]))
            bad[at : at + rng.randint(0, 3)] = bytes(rng.randrange(256) for _ in range(rng.randint(0, 3)))
        got = parse(bytes(bad))
        payload(bytes(bad), got), feature(got)
    for _ in range(100):
        head = bytes([0xFF, 0xE0 | rng.randrange(32), rng.randrange(256), rng.randrange(256)])
        got = parse((head + bytes(rng.randrange(256) for _ in range(rng.randint(0, 700)))) * 3)
        assert len(got.offsets) == len(got.sizes)
