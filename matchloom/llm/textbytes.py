"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a maximal run of 0-9, a-z (A-Z are lower-cased first) and of any character beyond ASCII. All
bytes of such characters are 128 or more, so words can be found byte by byte.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_CHUNK = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_CODES = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_SHORT = 128


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(lower_ascii(text)) if text else []


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one more at the end). Null is empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[ends[0] : ends[-1]], ends - ends[0]


def chunks(offsets: np.ndarray, size: int = _CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about so many bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(body: np.ndarray, offsets: np.ndarray, spaced: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words of these texts: hash, first byte, byte after the last; and words before each text.

    spaced: words are whatever stands between ASCII white space, as it is.
    """
    hashes, firsts, lasts = [], [], []
    for a, z in chunks(offsets):
        low, high = offsets[a], offsets[z]
        if low == high:
            continue
        part = body[low:high] if spaced else _LOWER[body[low:high]]
        inside = ~_SPACES[part] if spaced else _IN_WORD[part]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = offsets[a + 1 : z] - low
        cuts = cuts[(cuts > 0) & (cuts < high - low)]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not len(first):
            continue
        hashes.append(_hashed(part, first, last - first))
        firsts.append(first + low)
        lasts.append(last + low)
    if not hashes:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    first = np.concatenate(firsts)
    return np.concatenate(hashes), first, np.concatenate(lasts), np.searchsorted(first, offsets)


def _hashed(part: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes: eight bytes at a time, each step a bijection; long ones by BLAKE2b.

    So stretches of one length and up to eight bytes never share a hash, and no regular pattern of letters
    makes longer ones do so.
    """
    padded = np.concatenate([part, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(part) + 1, "<u8", padded, 0, (1,))
    h = mixed(sizes.astype(np.uint64) * _STEP)
    rest, done = np.flatnonzero(sizes <= _SHORT), 0
    while len(rest):
        left = np.minimum(sizes[rest] - done, 8).astype(np.uint64)
        code = eight[first[rest] + done] & (np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left))
        h[rest] = mixed((h[rest] ^ code) + _STEP)
        done += 8
        rest = rest[sizes[rest] > done]
    for k in np.flatnonzero(sizes > _SHORT).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(part[first[k] : first[k] + sizes[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def words_hashed(words: list[str]) -> np.ndarray:
    """The hash of each of these words, the same as word_hashes gives."""
    if not words:
        return np.zeros(0, np.uint64)
    body, offsets = text_bytes(pa.array(words, pa.string()))
    return word_hashes(body, offsets)[0]
