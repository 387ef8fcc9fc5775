"""Suffix arrays and decontamination against plain searches."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from matchloom.llm.decontaminate import _found, block_of, items_digest, remove_contaminated, search_benchmark
from matchloom.llm.suffixes import common_prefixes, search, suffix_array
from matchloom.llm.textbytes import text_bytes, word_hashes, words_hashed, words_of


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    codes = rng.integers(1, 4, 700)
    if seed % 2:
        codes[300:500] = codes[50:250]
    width, depth = (1, 1000) if seed < 3 else (8, 64)
    order, ranks = suffix_array(codes, depth, width)
    keys = [bytes(codes[k : k + depth].astype(np.uint8)) for k in order]
    assert sorted(order.tolist()) == list(range(700)) and keys == sorted(keys)
    assert all((ranks[a] == ranks[b]) == (x == y) for a, b, x, y in zip(order, order[1:], keys, keys[1:]))
    order, _ = suffix_array(codes, 700, width)
    places = np.empty(700, np.int64)
    places[order] = np.arange(700)
    got = common_prefixes(codes, order, places, 40, lane=64)
    raw = bytes(codes.astype(np.uint8))
    for k in range(1, 700):
        a, b, n = order[k - 1], order[k], 0
        while n < 40 and max(a, b) + n < 700 and raw[a + n] == raw[b + n]:
            n += 1
        assert got[k] == n


def test_search():
    codes = np.array([1, 2, 1, 2, 3, 0, 1, 2, 0])
    order, _ = suffix_array(codes, 9)
    rows = np.array([[1, 2], [2, 3], [3, 3]])
    sizes = np.array([2, 2, 2])
    n = search(codes, order, rows, sizes, True) - search(codes, order, rows, sizes, False)
    assert n.tolist() == [3, 1, 0]


def test_words_by_bytes():
    texts = ["Ab c-d", None, "", "é9É x", "  ", "Z" * 5000, "tail"]
    for cut in (0, 2):
        column = pa.array(texts)[cut:]
        body, offsets = text_bytes(column)
        hashes, first, last, before = word_hashes(body, offsets)
        want = [w for t in texts[cut:] for w in words_of(t)]
        assert hashes.tolist() == words_hashed(want).tolist()
        assert np.diff(before).tolist() == [len(words_of(t)) for t in texts[cut:]]


def brute(text, bench):
    words, hit, ids = words_of(text), set(), []
    longest = 0
    for key, item in bench:
        own, found = words_of(item), False
        size = min(10, len(own))
        for j in range(len(own) - size + 1) if own else ():
            for i in range(len(words) - size + 1):
                if words[i : i + size] == own[j : j + size]:
                    found = True
                    hit.update(range(i, i + size))
        for j in range(len(own)):
            for i in range(len(words)):
                n = 0
                while i + n < len(words) and j + n < len(own) and words[i + n] == own[j + n]:
                    n += 1
                longest = max(longest, n)
        if found:
            ids.append("" if key is None else str(key))
    return len(words), len(hit), sorted(ids), longest


@pytest.mark.parametrize("block_words", [2_000_000, 25])
def test_against_plain_search(spark, block_words):
    rng = random.Random(4)
    vocabulary = ["the", "of", "a", "b", "É", "9"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    bench = [(k, say(rng.choice([0, 3, 4, 10, 14, 20]))) for k in range(12)] + [(3, say(12)), (None, "Only; Words"), (20, None), (21, "solo"), (5, say(12)), (5, say(12))]
    bench[-1] = bench[-2]
    docs = [(k, say(rng.randint(0, 60)) + (f" {bench[k % 18][1]}. " if k % 3 == 0 and bench[k % 18][1] else "") + say(5), k) for k in range(60)]
    docs += [(100, None, 1), (101, "", 2), (None, "SOLO", 3), (102, "x solo y", 4), (102, "x solo y", 4), (103, "zz", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, words int")
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = search_benchmark(df, b, block_words=block_words).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"], r.longest_match) == brute(r.text, bench), r
        if r.longest_match:
            at = words_of(r.text)[r.longest_at : r.longest_at + r.longest_match]
            text = [x for k, x in bench if ("" if k is None else str(k)) == r.longest_item and x]
            assert any(" ".join(at) in " ".join(words_of(x)) for x in text)
    kept = remove_contaminated(df, b, block_words=block_words)
    assert kept.columns == df.columns and kept.count() == sum(r.n_hit == 0 for r in got)
    assert search_benchmark(df.limit(0), b).count() == 0 and search_benchmark(df, b.limit(0)).filter("n_hit > 0").count() == 0
    assert items_digest([]) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


@pytest.mark.parametrize("block_words", [2_000_000, 3])
def test_single_words_are_matches_of_one(spark, block_words):
    bench = [(1, "alpha beta gamma"), (2, "delta"), (3, "beta epsilon zeta")]
    docs = [(1, "x gamma y alpha"), (2, "x y"), (3, "x delta zeta"), (4, "zeta alpha beta"), (5, None), (6, "x epsilon")]
    got = search_benchmark(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), block_words=block_words)
    got = {r.doc_id: (r.longest_match, r.longest_at, r.longest_item, r.n_hit) for r in got.collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 0, 3: 1, 4: 2, 5: 0, 6: 1}
    assert got[1] == (1, 1, "1", 0) and got[2] == (0, -1, None, 0) and got[4][1:3] == (1, "1") and got[6] == (1, 1, "3", 0)
    assert got[3][3] == 1 and got[3][1:3] in ((1, "2"), (2, "3"))


def test_a_very_long_item(spark):
    rng = random.Random(6)
    item = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    docs = [(1, " ".join(["x"] * 5 + item + ["y"] * 5)), (2, " ".join(item[7000:9000])), (3, " ".join(item[:9])), (4, " ".join(item[100:400] + ["q"] + item[400:900]))]
    began = time.perf_counter()
    got = {r.doc_id: r for r in search_benchmark(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert time.perf_counter() - began < 30
    assert [(got[k].n_hit, got[k].longest_match, got[k].longest_at) for k in (1, 2, 3, 4)] == [(20_000, 20_000, 5), (2000, 2000, 0), (0, 9, 0), (800, 500, 301)]
    assert got[4].hit_spans == [0, 300, 301, 801]


def test_many_items_with_one_preamble(spark):
    preamble = " ".join(f"p{k}" for k in range(40))
    bench = [(k, f"{preamble} own {k} words {k * 7}") for k in range(10_000)]
    docs = [(1, f"{preamble} " * 20), (2, "own 5 words 35 and " * 3), (3, f"{preamble} own 5 words 35")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in search_benchmark(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), b).collect()}
    assert time.perf_counter() - began < 90
    assert len(got[1]["items"]) == len(got[3]["items"]) == 10_000 and got[1].n_hit == 800 and got[2].n_hit == 0
    assert got[3].longest_match == 44 and got[3].longest_item == "5" and got[2].longest_match == 4


def test_words_that_share_a_hash_are_told_apart(spark, monkeypatch):
    block = block_of([("1", "one two three"), ("2", "four")])
    block.hashes[:] = np.where(block.left > 0, words_hashed(["same"])[0], np.uint64(0))
    rows = _found(block, pa.array(["same same same", "x"]))
    assert [r[1:3] for r in rows] == [(0, []), (0, [])]
