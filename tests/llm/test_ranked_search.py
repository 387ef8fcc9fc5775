"""Ranked search against scoring every document for every item."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from matchloom.llm.ranked_search import Heaps, Items, search
from matchloom.llm.textbytes import words_of

DOCS, ITEMS = "doc_id long, text string", "item_id string, text string"


def brute(docs, items, best=10):
    counts = [Counter(words_of(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    total, length = sum(n > 0 for n in sizes), sum(sizes)
    out = []
    for item, text in items:
        found = []
        for (doc, _), c, n in zip(docs, counts, sizes):
            score = 0
            for term, times in Counter(words_of(text)).items():
                if c[term]:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * sum(x[term] > 0 for x in counts) + 1)))
                    score += times * w * ((10**9 * c[term]) // (1000 * c[term] + 8 * (25 + (75 * n * total) // length)))
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(found)[:best])]
    return sorted(out, key=repr)


def table(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["É", "été", "Ab", "aB", "x1"]
    say = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n"]) for _ in range(k))
    docs = [(rng.randint(0, 10**6) * 7, say(rng.randint(0, 60))) for _ in range(n)]
    docs += [(docs[3][0], docs[4][1]), docs[5], docs[5], (None, docs[6][1]), (None, docs[6][1]), (None, None), (9, None), (10, ""), (11, " ,.-"), (12, "w1 " * 30_000)]
    items = [(f"i{k}", say(rng.randint(1, 12))) for k in range(15)] + [("twice", "W1 w2"), ("twice", "w1 w1 w2"), (None, "ab"), ("none", "?!"), ("null", None), ("far", "nowhere")]
    return docs, items


@pytest.mark.parametrize(("seed", "window", "words"), [(1, 8192, 250_000), (2, 8, 30), (3, 1, 1)])
def test_against_every_document(spark, seed, window, words):
    docs, items = table(seed)
    df = spark.createDataFrame([(a, b, 5, "x") for a, b in docs], DOCS + ", n int, terms string").select("*", "n")
    of = spark.createDataFrame([(a, b, 1) for a, b in items], ITEMS + ", score int").repartition(3)
    got = search(df, of, window=window, block_words=words).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(docs, items)


def test_ties_take_the_smallest_ids(spark):
    docs = [(k, "same words here") for k in random.Random(4).sample(range(1000), 60)] + [(2000 + k, "other") for k in range(80)]
    got = search(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame([("a", "words")], ITEMS), window=16).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(k for k, t in docs if t != "other")[:10]


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([("i", "a")], ITEMS)
    assert search(docs.limit(0), items).count() == 0 and search(docs, items.limit(0)).count() == 0
    assert search(spark.createDataFrame([(1, None)], DOCS), items).count() == 0


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    items = Items([(0, "alpha beta")])
    items.hashes = np.full(2, 7, np.uint64)
    heaps = Heaps(items, [3, 4], 2, 10, 5)
    heaps.window([5, 6, 7], np.array([2, 2, 2]), np.array([0, 1, 2, 4]), np.array([0, 1, 0, 1]), np.array([1, 1, 1, 1]))
    m = 25 + 75 * 2 * 5 // 10
    one = 10**9 // (1000 + 8 * m)
    assert sorted(heaps.heaps[0]) == [(4 * one, -1, 6), (7 * one, -2, 7)]
    # a word of the same hash and length as a term is not the term
    import pyarrow as pa

    from matchloom.llm import ranked_search

    class Held:
        value = Items([(0, "alpha beta")])

    real = ranked_search.word_hashes

    def same(body, offsets):
        hashes, first, last, before = real(body, offsets)
        return np.where(np.isin(hashes, Held.value.hashes), hashes, Held.value.hashes[0]), first, last, before

    monkeypatch.setattr(ranked_search, "word_hashes", same)
    batch = pa.record_batch([pa.array([1, 2]), pa.array(["alpha gamma beta BETA delta", "zz"])], ["doc_id", "text"])
    rows = pa.Table.from_batches(ranked_search._term_counts(Held)(iter([batch]))).to_pylist()
    assert rows == [{"doc_id": 1, "n": 5, "terms": [0, 1], "tf": [1, 2]}, {"doc_id": 2, "n": 1, "terms": [], "tf": []}]
    Held.value.hashes = np.full(2, Held.value.hashes[0], np.uint64)
    rows = pa.Table.from_batches(ranked_search._term_counts(Held)(iter([batch]))).to_pylist()
    assert rows[0] == {"doc_id": 1, "n": 5, "terms": [0, 1], "tf": [1, 2]}
