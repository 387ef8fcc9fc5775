"""MPEG audio columns: build streams, find their frames again, and index them for exact seeking.

A built stream is an ID3v2.4 tag, an Info frame with the table of a variable-bitrate header, and Layer
III frames (44.1 kHz, mono, 192 kbit/s, with CRC) whose side information is all zero, so that they play as
silence. Each carries one unit of 576 payload bytes as ancillary data behind its side information.

The parser takes any bytes, and MPEG 1, 2 or 2.5 streams of Layers I to III: it resynchronises on frame
headers (one counts only if another header, a tag or the end follows where it says), reads Xing, Info and
VBRI tables with their seek entries, and verifies the CRC of every frame that has one. Of tags it reads text
frames of ID3v2.2 to 2.4 and the fields of ID3v1; compressed and encrypted tag frames are passed over.
Free-format frames (without a bitrate in their header) are not read. What a damaged stream does not give is
null; it never stops a job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import prepare

UNIT = 576

# Fixed values of the standard: kbit/s by (version 1 or not, layer), by index 1 to 14.
_KBPS = {
    (True, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
# Fixed values of the standard: sample rates by the header's version bits.
_RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


@dataclass(frozen=True)
class Header:
    version: int  # the header's bits: 3 is MPEG 1, 2 is MPEG 2, 0 is MPEG 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    joint: int  # subbands from here on share their bit allocation between channels; 32: none does

    @property
    def samples(self) -> int:
        if self.layer == 1:
            return 384
        return 576 if self.layer == 3 and self.version != 3 else 1152

    @property
    def side(self) -> int:
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


def header_at(raw: bytes, at: int) -> Header | None:
    """The frame header at a place, or None if there is none (free-format frames count as none)."""
    if at + 4 > len(raw) or raw[at] != 0xFF or raw[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = raw[at + 1 : at + 4]
    version, layer, rate, index = b1 >> 3 & 3, 4 - (b1 >> 1 & 3), b2 >> 2 & 3, b2 >> 4
    if version == 1 or layer == 4 or rate == 3 or index in (0, 15) or b3 & 3 == 2:
        return None
    kbps, hz, pad = _KBPS[version == 3, layer][index - 1], _RATES[version][rate], b2 >> 1 & 1
    if layer == 1:
        size = (12000 * kbps // hz + pad) * 4
    else:
        size = (72000 if layer == 3 and version != 3 else 144000) * kbps // hz + pad
    return Header(version, layer, not b1 & 1, kbps, hz, b3 >> 6 == 3, size, 4 + 4 * (b3 >> 4 & 3) if b3 >> 6 == 1 else 32)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << np.uint32(8)
    for _ in range(8):
        table = np.where(table & 0x8000, table << np.uint32(1) ^ np.uint32(0x8005), table << np.uint32(1)) & np.uint32(0xFFFF)
    return table


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The frame checksum (0x8005, starting at 0xFFFF) of each row of bytes."""
    crc = np.full(len(rows), 0xFFFF, np.uint32)
    for k in range(rows.shape[1]):
        crc = (crc << np.uint32(8) ^ _CRC[crc >> np.uint32(8) ^ rows[:, k]]) & np.uint32(0xFFFF)
    return crc


def _allocation_bits(head: Header) -> list[int]:
    """Bits of the allocation of each subband in a Layer II frame, as the standard's tables have them."""
    if head.version != 3:
        return [4] * 4 + [3] * 7 + [2] * 19
    each = head.kbps if head.mono else head.kbps // 2
    if each <= 48:
        return [4] * 2 + [3] * (10 if head.rate == 32000 else 6)
    return [4] * 11 + [3] * 12 + [2] * (4 if each <= 80 or head.rate == 48000 else 7)


def _wrong(rows: np.ndarray, head: Header) -> int:
    """How many of some protected frames, a row each, have another checksum than they say.

    It covers half the header and what follows the checksum: side information (Layer III), bit allocation
    (I), or bit allocation and scale factor selection (II), whose bits depend on the allocation.
    """
    said = rows[:, 4] * np.uint32(256) + rows[:, 5]
    if head.layer != 2:
        covered = head.side if head.layer == 3 else 16 if head.mono else (32 + head.joint) // 2
        if 6 + covered > head.size:
            return len(rows)
        return int((crc16(np.concatenate([rows[:, 2:4], rows[:, 6 : 6 + covered]], axis=1)) != said).sum())
    bits = np.unpackbits(rows[:, 6 : 6 + 64], axis=1)  # 308 are the most that are covered
    at, used = 0, np.zeros(len(rows), np.int64)
    for band, n in enumerate(_allocation_bits(head)):
        shared = not head.mono and band >= head.joint
        for _ in range(1 if head.mono or shared else 2):
            used += bits[:, at : at + n].any(1) * (2 if shared else 1)
            at += n
    length = at + 2 * used
    crc = crc16(rows[:, 2:4])
    for k in range(min(int(length.max()), bits.shape[1])):
        step = (crc << np.uint32(1) ^ ((crc >> np.uint32(15) ^ bits[:, k]) & np.uint32(1)) * np.uint32(0x8005)) & np.uint32(0xFFFF)
        crc = np.where(k < length, step, crc)
    return int(((crc != said) | (length > bits.shape[1])).sum())


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _unsyncsafe(raw: bytes) -> int:
    return sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0)))


_HEAD = bytes([0xFF, 0xFA, 0xB0, 0xC0])
_FRAME = header_at(_HEAD, 0).size
_BODY = 4 + 2 + 17
_SIDE_CRC = int(crc16(np.frombuffer(_HEAD[2:] + bytes(17), np.uint8)[None])[0])


def build(data: bytes) -> bytes:
    """A stream that carries these bytes, with bytes 255 after them up to a positive multiple of 576."""
    count = max(1, -(-len(data) // UNIT))
    payload = data.ljust(count * UNIT, b"\xff")
    frames = np.zeros((count + 1, _FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(_HEAD, np.uint8)
    frames[:, 4:6] = [_SIDE_CRC >> 8, _SIDE_CRC & 255]
    frames[1:, _BODY : _BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(count, UNIT)
    total = frames.size
    toc = bytes(min(255, 256 * ((k * count // 100) + 1) * _FRAME // total) for k in range(100))
    info = b"Info" + struct.pack(">III", 7, count, total) + toc
    frames[0, _BODY : _BODY + len(info)] = np.frombuffer(info, np.uint8)
    notes = {"bytes": len(data), "unit": UNIT, "crc32": zlib.crc32(payload)}
    tag = b""
    for k, v in notes.items():
        text = b"\x03" + k.encode() + b"\x00" + str(v).encode()
        tag += b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _syncsafe(len(tag)) + tag + frames.tobytes()


@dataclass
class Stream:
    """What a stream holds. offsets and sizes are those of its audio frames, the table's frame left out."""

    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    toc_bytes: tuple[int, ...] = ()  # VBRI: bytes of each stretch of toc_frames frames
    toc_frames: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    samples: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    rate: int = 0
    kbps: tuple[int, ...] = ()
    checked: int = 0
    wrong: int = 0
    skipped: int = 0
    resyncs: int = 0
    data_at: int = 0

    @property
    def seconds(self) -> Fraction:
        return Fraction(int(self.samples.sum()), self.rate) if self.rate else Fraction(0)

    def seek(self, sample: int) -> tuple[int, int]:
        """The byte offset of the frame that holds a sample, and that frame's first sample."""
        ends = np.cumsum(self.samples)
        k = min(int(np.searchsorted(ends, sample, side="right")), len(ends) - 1)
        return int(self.offsets[k]), int(ends[k] - self.samples[k])


# Fixed values of the format: the fields of an ID3v1 tag, with their places.
_V1 = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97), "comment": (97, 127)}


def _v1(raw: bytes, found: dict[str, str]) -> None:
    """Read an ID3v1 tag (its 128 bytes); fields that are empty are left out."""
    for name, (a, z) in _V1.items():
        if value := raw[a:z].split(b"\0")[0].decode("latin-1").strip():
            found.setdefault(f"id3v1.{name}", value)


def _tags(raw: bytes, at: int, found: dict[str, str]) -> int:
    """Read an ID3v2 tag's text frames; the place behind the tag, or the same place if there is none."""
    if raw[at : at + 3] != b"ID3" or at + 10 > len(raw):
        return at
    major, flags, end = raw[at + 3], raw[at + 5], at + 10 + _unsyncsafe(raw[at + 6 : at + 10])
    held = raw[at + 10 : end]
    if flags & 0x80 and major < 4:
        held = held.replace(b"\xff\0", b"\xff")
    k, wide = 0, 6 if major == 2 else 10
    if flags & 0x40 and major > 2:  # an extended header
        k = _unsyncsafe(held[:4]) if major >= 4 else 4 + int.from_bytes(held[:4])
    while 2 <= major <= 4 and k + wide <= len(held) and held[k]:
        name = held[k : k + (3 if major == 2 else 4)].decode("latin-1")
        size = int.from_bytes(held[k + 3 : k + 6]) if major == 2 else _unsyncsafe(held[k + 4 : k + 8]) if major == 4 else int.from_bytes(held[k + 4 : k + 8])
        body = held[k + wide : k + wide + size]
        packed = major > 2 and held[k + 9] & (0x0C if major == 4 else 0xC0)
        if name[0] == "T" and body and not packed:
            kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8")
            key, _, value = body[1:].decode(kind, "replace").partition("\0")
            found |= {key: value.rstrip("\0")} if name in ("TXXX", "TXX") else {name: key}
        k += wide + size
    return min(end + 10 * bool(flags & 0x10), len(raw))


def _vbr(raw: bytes, at: int, head: Header, out: Stream) -> bool:
    """Read a Xing, Info or VBRI table if this frame holds one."""
    k = at + 4 + 2 * head.protected + head.side
    if (name := raw[k : k + 4]) in (b"Xing", b"Info"):
        flags, k = int.from_bytes(raw[k + 4 : k + 8]), k + 8
        out.table = name.decode()
        if flags & 1:
            out.table_frames, k = int.from_bytes(raw[k : k + 4]), k + 4
        if flags & 2:
            out.table_bytes, k = int.from_bytes(raw[k : k + 4]), k + 4
        if flags & 4:
            out.toc = raw[k : k + 100]
        return True
    if raw[at + 36 : at + 40] == b"VBRI":
        out.table = "VBRI"
        out.table_bytes, out.table_frames = (int.from_bytes(raw[at + k : at + k + 4]) for k in (46, 50))
        entries, scale, width, out.toc_frames = (int.from_bytes(raw[at + k : at + k + 2]) for k in (54, 56, 58, 60))
        table = raw[at + 62 : at + min(62 + entries * width, head.size)]
        out.toc_bytes = tuple(scale * int.from_bytes(table[k : k + width]) for k in range(0, len(table) - width + 1, width)) if width else ()
        return True
    return False


def parse(raw: bytes) -> Stream:
    """Frames, tags, table, checksums and exact times of a stream. Bytes without a frame give no frames."""
    out, end = Stream(), len(raw)
    at = _tags(raw, 0, out.tags)
    if raw[-128:-125] == b"TAG" and end - 128 >= at:
        end -= 128
        _v1(raw[end:], out.tags)
    body = np.frombuffer(raw, np.uint8)
    runs: list[tuple[int, int, Header]] = []
    lost = False
    while at + 4 <= end:
        head = header_at(raw, at)
        fits = head is not None and at + head.size <= end
        if fits and (lost or not runs):  # after a gap, the next header must be where this one says
            after = at + head.size
            fits = after == end or header_at(raw, after) is not None or raw[after : after + 3] == b"ID3"
        if not fits:
            if raw[at : at + 3] == b"ID3" and (behind := _tags(raw, at, out.tags)) > at:
                at = behind
                continue
            out.resyncs += not lost
            step = raw.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out.skipped, at, lost = out.skipped + step - at, step, True
            continue
        lost = False
        if not runs and not out.table and _vbr(raw, at, head, out):
            at += head.size
            out.data_at = at
            continue
        n = (end - at) // head.size
        same = (body[at : at + n * head.size].reshape(n, head.size)[:, :4] == body[at : at + 4]).all(1)
        n = n if same.all() else int(np.argmin(same))
        runs.append((at, n, head))
        at += n * head.size
    out.skipped += max(0, end - at) if at < end else 0
    if not runs:
        return out
    out.rate = runs[0][2].rate
    out.kbps = tuple(sorted({h.kbps for *_, h in runs}))
    out.offsets = np.concatenate([a + h.size * np.arange(n, dtype=np.int64) for a, n, h in runs])
    out.sizes = np.concatenate([np.full(n, h.size, np.int64) for _, n, h in runs])
    out.samples = np.concatenate([np.full(n, h.samples, np.int64) for _, n, h in runs])
    for a, n, h in runs:
        if h.protected:
            out.checked += n
            out.wrong += _wrong(body[a : a + n * h.size].reshape(n, h.size), h)
    return out


def _number(tags: dict[str, str], key: str) -> int | None:
    value = tags.get(key, "")
    return int(value) if value.isascii() and value.isdigit() and len(value) <= 18 else None


def payload(raw: bytes, stream: Stream) -> bytes | None:
    """The bytes that build() put into the frames of a stream, padding included; None if they are not there whole."""
    unit, said = _number(stream.tags, "unit"), _number(stream.tags, "crc32")
    if not unit or said is None or stream.wrong or not len(stream.offsets) or _BODY + unit > int(stream.sizes.min()):
        return None
    at = stream.offsets[:, None] + np.arange(_BODY, _BODY + unit)
    found = np.frombuffer(raw, np.uint8)[at].tobytes()
    return found if zlib.crc32(found) == said else None


def feature(stream: Stream) -> str:
    """The probe of a stream as one string: the same for the same bytes."""
    ms = stream.seconds
    return (
        f"{stream.table or 'none'};frames={len(stream.offsets)};rate={stream.rate};kbps={'/'.join(map(str, stream.kbps))};"
        f"seconds={ms.numerator}/{ms.denominator};crc={stream.checked - stream.wrong}/{stream.checked};"
        f"resyncs={stream.resyncs};skipped={stream.skipped};seek={zlib.crc32(stream.offsets.astype('<i8').tobytes())}"
    )


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            made = [build((t.as_py() or "").encode()) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], ["doc_id", "media"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media: each whole text (null: empty) as the payload of a stream.

    Every row gives one row, so repeated rows, ties and null ids stay; an empty table gives none. Other
    columns are left out, whatever their names.
    """
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode, "doc_id long, media binary")


_PROBED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_ms double, crc_ok boolean, seek_offsets array<long>"


def _probe(seek_every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not media.is_valid:
                    rows.append((doc, *[None] * 11))
                    continue
                raw = media.as_py()
                got = parse(raw)
                held, size = payload(raw, got), _number(got.tags, "bytes")
                damaged = got.wrong > 0 or ("unit" in got.tags and held is None)
                rows.append((
                    doc, size if held is not None and size is not None and size <= len(held) else None,
                    *((None,) * 3 if held is None else (len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-32:]))),
                    len(raw), hashlib.sha256(raw).hexdigest(), feature(got), len(got.offsets),
                    float(got.seconds * 1000), False if damaged else True if got.checked else None, got.offsets[::seek_every].tolist(),
                ))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.list_(pa.int64())]
            names = [f.split()[0] for f in _PROBED.split(", ")]
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return run


def probe(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", seek_every: int = 1) -> DataFrame:
    """Parse stored streams: what is in them, exact durations, checksums, and frame seek offsets.

    seek_offsets has the byte offset of every frame, or of every seek_every-th. n_bytes and the payload
    columns are null where build() did not make the stream or its payload is not there whole. crc_ok is false
    where a frame's checksum is wrong or a payload is damaged, and null where nothing could be checked. Null media
    give nulls; bytes without any frame give no frames and a duration of 0. Every row gives one row.
    """
    prepare(media.sparkSession)
    return media.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(_probe(seek_every), _PROBED)
