"""Passages of earlier documents against counting every window."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from matchloom.llm.reference_parse import Block, remove_repeated_passages, segments
from matchloom.llm.textbytes import text_bytes, word_hashes

SCHEMA = "doc_id long, text string"
LAST = 2**63 - 1


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), ws in zip(rows, words):
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            first[key] = min(first.get(key, LAST), LAST if doc is None else doc)
    out = []
    for (doc, _), ws in zip(rows, words):
        gone = [False] * len(ws)
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < (LAST if doc is None else doc):
                gone[k : k + window] = [True] * window
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((doc, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def corpus(seed, n=50):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "É", "d.", "e"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [say(k) for k in (6, 9, 14, 30, 60)]
    rows = []
    for _ in range(n):
        parts = say(rng.randint(0, 25))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 3)
            parts += p[a : len(p) - rng.randint(0, len(p) // 3)] + say(rng.randint(0, 8))
        rows.append("".join(w + rng.choice([" ", " ", "  ", "\n", "\t\r\n", "\x0b"]) for w in parts))
    rows += [rows[3], rows[4], rows[4], None, "", "x", "same " * 90, "same " * 40, "y " * 12, "y " * 13, "z " * 13, "\x1cw\x85 " * 30, "\x1cw\x85 " * 30]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


@pytest.mark.parametrize(("seed", "window", "gram", "block"), [(1, 13, 4, 8192), (2, 5, 2, 8192), (3, 5, 2, 3), (4, 7, 3, 1), (5, 4, 4, 6)])
def test_against_all_windows(spark, seed, window, gram, block):
    rows = corpus(seed)
    rows += [(None, rows[5][1]), (None, rows[5][1]), (None, None), rows[6], rows[6], (7, "other " * 30), (-3, rows[8][1])]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], SCHEMA + ", anchor string, n int").select("*", "n")
    got = remove_repeated_passages(df, window=window, gram=gram, block=block).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows, window)


def test_empty(spark):
    assert remove_repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r["n_words"] for r in remove_repeated_passages(spark.createDataFrame([(1, None), (None, "")], SCHEMA)).collect()] == [0, 0]


def test_windows_are_in_one_segment_and_equal_ones_share_an_anchor():
    texts = [t for _, t in corpus(6)]
    body, offsets = text_bytes(pa.array(texts))
    hashes, _, _, before = word_hashes(body, offsets, spaced=True)
    anchor, text, first, n = segments(hashes, before, 5, 2)
    seen, of = {}, {}
    for a, t, f, k in zip(anchor.tolist(), text.tolist(), first.tolist(), n.tolist()):
        words = (texts[t] or "").encode().split()
        for j in range(f, f + k):
            assert (t, j) not in seen and of.setdefault(tuple(words[j : j + 5]), a) == a
            seen[t, j] = True
    assert len(seen) == sum(max(0, len((t or "").encode().split()) - 4) for t in texts)


@pytest.mark.parametrize("seed", range(4))
def test_factors_are_the_longest_of_earlier_documents(seed):
    rng = np.random.default_rng(seed)
    pieces = [[f"w{x}" for x in rng.integers(0, 3, rng.integers(1, 25))] for _ in range(30)]
    docs = rng.integers(0, 12, 30)
    block = Block(pa.array([" ".join(p) for p in pieces]), docs)
    has = lambda words, below: any(d < below and words == q[j : j + len(words)] for q, d in zip(pieces, docs) for j in range(len(q) - len(words) + 1))
    ends = {}
    for k, at, size in sorted(zip(*(x.tolist() for x in block.parse(5)))):
        own, at = pieces[k], at - int(block.begin[k])
        assert at == ends.get(k, 0)
        ends[k] = at + max(size, 1)
        assert (size == 0 or has(own[at : at + size], docs[k])) and (at + size == len(own) or not has(own[at : at + size + 1], docs[k]))
    got = {(k, w) for k, a, z in zip(*(x.tolist() for x in block.repeated(5))) for w in range(a, z + 1)}
    assert got == {(k, w) for k, p in enumerate(pieces) for w in range(len(p) - 4) if has(p[w : w + 5], docs[k])}


def test_regular_words_do_not_collide(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = [(1, " ".join([a] * 20)), (2, " ".join([b] * 20)), (3, " ".join([b] * 15))]
    assert sorted((r["doc_id"], r["n_removed"]) for r in remove_repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()) == [(1, 0), (2, 0), (3, 15)]
