"""Repeated strings against counting every window."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from matchloom.llm.suffix_dedup import Shard, _search_shard, remove_repeats, repeated_between, repeated_within, segments
from matchloom.llm.textbytes import text_bytes

SCHEMA = "doc_id long, text string"


def brute(rows, window):
    raws = [(t or "").encode() for _, t in rows]
    times = Counter(r[k : k + window] for r in raws for k in range(len(r) - window + 1))
    out = []
    for (doc, _), raw in zip(rows, raws):
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - window + 1):
            if times[raw[k : k + window]] > 1:
                gone[k : k + window] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(gone[k] and not gone[k - 1] for k in range(len(raw)))
        out.append((doc, len(raw), int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [say(n) for n in (30, 70, 90, 250, 420)]
    rows = []
    for _ in range(60):
        parts = [say(rng.randint(0, 200))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += [p[a : len(p) - rng.randint(0, len(p) // 3)], say(rng.randint(0, 60))]
        rows.append("".join(parts))
    rows += [rows[3], rows[4], rows[4], None, "", "x", "ab" * 700, "é" * 500, "z" * 199, "z" * 200, "z" * 201, passages[4], "same line\n" * 90]
    return [(k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "window", "gram", "shard"), [(1, 200, 64, 8192), (2, 64, 16, 8192), (3, 64, 16, 5), (4, 40, 16, 2)])
def test_against_all_windows(spark, seed, window, gram, shard):
    rows = corpus(seed)
    rows += [(None, rows[5][1]), (None, None), rows[6], rows[6], (7, "other " * 3)]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA + ", anchor string, n int")
    got = remove_repeats(df, window=window, gram=gram, shard=shard).drop("kept").collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, window)


def test_empty(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_windows_are_in_one_segment_and_equal_ones_share_an_anchor():
    import pyarrow as pa

    texts = [t for _, t in corpus(5)]
    body, offsets = text_bytes(pa.array(texts))
    anchor, text, first, n = segments(body, offsets, 64, 16)
    seen, of = Counter(), {}
    for a, t, f, k in zip(anchor, text, first, n):
        raw = (texts[t] or "").encode()
        for j in range(f, f + k):
            seen[t, j] += 1
            assert of.setdefault(raw[j : j + 64], a) == a
    assert set(seen.values()) == {1} and len(seen) == sum(max(0, len((t or "").encode()) - 63) for t in texts)


def test_shards_within_and_between():
    import pyarrow as pa

    texts = [t or "" for _, t in corpus(6)]
    count = lambda ts: Counter(r[k : k + 64] for r in (t.encode() for t in ts) for k in range(len(r) - 63))
    shards = [Shard(*text_bytes(pa.array(t)), 64) for t in (texts[::2], texts[1::2])]
    for shard, mine in zip(shards, (texts[::2], texts[1::2])):
        times = count(mine)
        want = [times[r[k : k + 64]] > 1 for r in (t.encode() for t in mine) for k in range(max(0, len(r) - 63))]
        assert repeated_within(shard).tolist() == want
    for got, mine, theirs in zip(repeated_between(*shards), (texts[::2], texts[1::2]), (texts[1::2], texts[::2])):
        times = count(theirs)
        assert got.tolist() == [times[r[k : k + 64]] > 0 for r in (t.encode() for t in mine) for k in range(max(0, len(r) - 63))]


def test_a_kind_is_repeated_only_if_its_bytes_are():
    import pyarrow as pa

    rng = random.Random(7)
    one, other = (bytes(rng.randrange(256) for _ in range(90)) for _ in range(2))
    found = {}
    for name, bodies in (("equal", [one, one]), ("collision", [one, other]), ("partly", [one, one[:70] + other[70:]])):
        table = pa.table({"side": [2, 2], "anchor": [5, 5], "seg": [6, 6], "seg2": [7, 7], "weight": [2, 2], "body": bodies})
        rows = _search_shard(64)(table).to_pylist()
        found[name] = {(r["anchor"], r["seg"], r["low"], r["high"]) for r in rows}
    assert found == {"equal": {(5, 6, 0, 26)}, "collision": set(), "partly": {(5, 6, 0, 6)}}


def test_many_repeated_rows_and_places(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcd ") for _ in range(700))
    rows = [(1, text)] * 40 + [(k, text[:300]) for k in range(2, 30)] + [(30, text[50:] + "x" * 250), (None, text)]
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA), shard=3).drop("kept").collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, 200)


def test_middle_places_of_regular_bytes_are_told_apart(spark):
    """Three documents whose polynomial hashes agree: only the equal ones lose their bytes, the middle one keeps its own."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    for middle in (a, b):
        rows = [(1, a), (2, middle), (3, a), (4, "x" + b[:150])]
        got = remove_repeats(spark.createDataFrame(rows, SCHEMA)).drop("kept").collect()
        assert sorted([tuple(r) for r in got], key=repr) == brute(rows, 200)
