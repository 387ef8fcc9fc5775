"""Token ids as directly addressable codes.

Each id is cut into chunks of eight bits. Level k holds the k-th chunk of every id that has one, and a
bitmap beside it says which ids go on to level k + 1. A rank directory (ones before every 512th bit)
finds an id's place on the next level, so any id is read by one step a level, and no block is decoded.

A file is a Parquet table of segments; a segment is a row with the codes of some whole documents in
ascending doc_id order, the documents' ids and where each begins. Files are not compressed, their rows are in
order of position, and pages are small, so the page index leads from a position to the one page with its
segment: reading an id reads that page and inflates nothing.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import trimmed
from .storage import prepare

END_ID = 1
#: Ids of a segment (one longer document at least), and bytes of a page.
_SEGMENT = 1 << 14
_PAGE = 1 << 16
_SEGMENT_SCHEMA = "part int, first long, last long, doc_ids array<bigint>, starts array<bigint>, codes binary"
#: Texts of these characters alone split into pieces the same way whether seen whole or piece by piece.
_PLAIN = re.compile("[\\x20-\\x7e\\n\\t\\rÀ-ÖØ-öø-įı-ɏЀ-ҁҊ-ԯ]*")
_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\x80-\xff]+|[0-9]|[^\x00-\x200-9a-z\x80-\xff]+")
_MOST_KNOWN = 300_000


# The normalizer and pre-tokenizer of the files whose words _PIECE finds.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 is itself, the rest follow at 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def splits_alike(path: str) -> bool:
    """Whether a tokenizers file normalises and splits texts in the way that _PLAIN and _PIECE know."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    parts = [whole.get(k) or {} for k in ("normalizer", "pre_tokenizer")]
    known = parts[0].get("normalizers") == _NORMALIZERS and parts[1].get("pretokenizers") == [_SPLIT, _BYTES]
    return known and whole["model"]["type"] == "BPE" and not whole["model"].get("dropout") and not whole.get("post_processor")


class Encoder:
    """Ids of whole texts by a tokenizers file; pieces seen before are looked up.

    That holds for files whose normalizer and pre-tokenizer are those known here (splits_alike), and texts of
    the characters of _PLAIN without the file's own control strings. All else takes the library's way from
    end to end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.known_split = splits_alike(path)
        self.control = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}  # what was known before known grew too large

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode pieces that are not known. A piece is a word to the file's model, so it needs no splitting again."""
        tokenize, letters = self.model.model.tokenize, self.letters
        for p in pieces:
            word = p if p.isascii() else p.decode().lower().encode()
            self.known[p] = array("I", [t.id for t in tokenize(word.decode("latin-1").translate(letters))]).tobytes()

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. What is not known yet is encoded for all of them together."""
        split = [None if not self._plain(t) else _PIECE.findall(t.encode().lower()) for t in texts]
        if len(self.known) > _MOST_KNOWN:
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        for p in {p for pieces in split if pieces for p in pieces}:
            if p not in known:
                if (ids := older.get(p)) is None:
                    new.append(p)
                else:
                    known[p] = ids
        self._learn(new)
        return [
            np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4") if pieces is None else np.frombuffer(b"".join([known[p] for p in pieces]), "<u4")
            for text, pieces in zip(texts, split)
        ]

    def _plain(self, text: str) -> bool:
        return self.known_split and bool(_PLAIN.fullmatch(text)) and unicodedata.is_normalized("NFC", text) and not any(c in text for c in self.control)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pack(ids: np.ndarray) -> bytes:
    """Ids (unsigned, up to 32 bits) as directly addressable codes."""
    rest, levels = np.ascontiguousarray(ids, np.uint32), []
    while True:
        more = rest > 255
        ones = np.packbits(more, bitorder="little")
        blocks = np.zeros(-(-len(rest) // 512) + 1, "<u4")
        if len(rest):
            per = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(rest), 512))
            blocks[1:] = np.cumsum(per)
        levels.append((len(rest), rest.astype(np.uint8).tobytes(), ones.tobytes(), blocks.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    head = struct.pack("<4sI", b"DAC1", len(levels)) + b"".join(struct.pack("<Q", n) for n, *_ in levels)
    return head + b"".join(x for _, *parts in levels for x in parts)


class Codes:
    """Reads packed ids: all of them, or any one."""

    def __init__(self, raw: bytes):
        magic, n = struct.unpack_from("<4sI", raw)
        if magic != b"DAC1":
            raise ValueError("not a table of directly addressable codes")
        sizes, at, self.levels = struct.unpack_from(f"<{n}Q", raw, 8), 8 + 8 * n, []
        for size in sizes:
            chunk = np.frombuffer(raw, np.uint8, size, at)
            ones = np.frombuffer(raw, np.uint8, -(-size // 8), at + size)
            at += size + len(ones)
            blocks = np.frombuffer(raw, "<u4", -(-size // 512) + 1, at)
            at += blocks.nbytes
            self.levels.append((chunk, ones, blocks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        value = 0
        for k, (chunk, ones, blocks) in enumerate(self.levels):
            value |= int(chunk[i]) << 8 * k
            if not ones[i >> 3] >> (i & 7) & 1:
                return value
            block = i >> 9
            bits = np.unpackbits(ones[block * 64 : (i >> 3) + 1], bitorder="little")
            i = int(blocks[block]) + int(bits[: i - (block << 9)].sum())
        return value

    def all(self) -> np.ndarray:
        out, at = self.levels[0][0].astype("<u4"), None
        for k in range(1, len(self.levels)):
            chunk, ones, _ = self.levels[k - 1]
            here = np.flatnonzero(np.unpackbits(ones, count=len(chunk), bitorder="little"))
            at = here if at is None else at[here]
            out[at] |= self.levels[k][0].astype("<u4") << np.uint32(8 * k)
        return out


def _segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, done = encoder(path), TaskContext.get().partitionId(), 0
        docs, starts, held, size = [], [], [], 0
        end = np.array([end_id], "<u4")

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([done], pa.int64()), pa.array([done + size], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())), pa.array([pack(np.concatenate(held))], pa.binary())],
                ["part", "first", "last", "doc_ids", "starts", "codes"],
            )

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                ids, texts = (c.to_pylist() for c in batch.slice(k, 512).columns)
                for doc, got in zip(ids, model.encode_many([t or "" for t in texts])):
                    docs.append(doc)
                    starts.append(size)
                    held += [got, end]
                    size += len(got) + 1
                    if size >= _SEGMENT:
                        yield flush()
                        done += size
                        docs, starts, held, size = [], [], [], 0
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Encode every whole text and write the ids to path in ascending order of id_col.

    Null texts are empty, and each document ends with end_id. Null ids come first; rows of equal ids go
    by their text, so reruns write the same ids. Repeated rows are written each time. An empty table
    writes no segment. Other columns are left out, whatever their names.

    Rows are dealt by range of (id, hash of text), so one id that many rows share is split as well. A
    task holds one segment of about 16,000 ids (or one longer document) at a time.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", "salt", "text"]
    dealt = rows.withColumn("salt", F.xxhash64("text")).repartitionByRange("doc_id", "salt").sortWithinPartitions(*order)
    out = dealt.select("doc_id", "text").mapInArrow(trimmed(_segments(tokenizer, end_id)), _SEGMENT_SCHEMA)
    layout = {"compression": "none", "parquet.page.size": str(_PAGE), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}
    out.write.options(**layout).parquet(path)


def part_offsets(segments: DataFrame) -> dict[int, int]:
    """Ids before each part. One row a writing task comes to the driver, whatever the documents."""
    out, before = {}, 0
    for part, n in segments.groupBy("part").agg(F.sum(F.col("last") - F.col("first")).alias("n")).orderBy("part").collect():
        out[part] = before
        before += n
    return out


def _documents(before: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, docs, starts, raw in zip(*(batch.column(i) for i in range(5))):
                ids = Codes(raw.as_py()).all()
                base, inner = before[part.as_py()] + first.as_py(), np.array([*starts.as_py(), len(ids)], np.int64)
                sums = [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(inner, inner[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs.as_py(), pa.int64()), pa.array(base + inner[:-1]), pa.array(np.diff(inner)), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the written files: doc_id, start, n_tokens, and ids_crc32 of the ids as read.

    start counts the ids of all documents before, n_tokens includes the end id, and the checksum is over
    the ids as little-endian unsigned 32-bit integers.
    """
    prepare(spark)
    segments = spark.read.schema(_SEGMENT_SCHEMA).parquet(path)
    before = part_offsets(segments)
    return segments.select("part", "first", "doc_ids", "starts", "codes").mapInArrow(_documents(before), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at a position among all ids, from the one page that holds it."""
    return tokens_at(spark, path, [position])[0]


def tokens_at(spark: SparkSession, path: str, positions: list[int]) -> list[int]:
    """The ids at some positions (a list from the caller), each by a read of its own page.

    One pass over part, first and last alone, which are a few bytes a segment, gives where each part begins.
    """
    segments = spark.read.schema(_SEGMENT_SCHEMA).parquet(path)
    before, out = part_offsets(segments), []
    for position in positions:
        part = max((p for p, n in before.items() if n <= position), default=None)
        inner = position - before.get(part, 0)
        here = segments.filter((F.col("part") == part) & (F.col("first") <= inner) & (F.col("last") > inner)).select("first", "codes").first() if part is not None and position >= 0 else None
        if here is None:
            raise IndexError(f"no id at {position}")
        out.append(Codes(bytes(here["codes"]))[inner - here["first"]])
    return out
