"""Segmentation sums against enumeration, and accuracy on held-out documents."""

import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from matchloom.llm import queries
from matchloom.llm.langid import Lattice, Model, Pieces, Scorer, _joined, _maximise, fit, predict
from matchloom.llm.textbytes import words_of


def enumerated(word, p):
    if not word:
        return 1.0
    return sum(p[word[:k]] * enumerated(word[k:], p) for k in range(1, len(word) + 1) if word[:k] in p)


def test_forward_sums_all_segmentations():
    rng = random.Random(3)
    pieces = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 4))) for _ in range(9)} | {b"a", b"b"})
    p = np.random.default_rng(1).random((len(pieces), 2))
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    lattice = Lattice(Pieces(pieces), _joined(words))
    got, back = lattice.log_probability(p), lattice.backward(p)
    for w, row, head in zip(words, got, lattice.head):
        for k in range(2):
            want = enumerated(w, dict(zip(pieces, p[:, k])))
            assert math.isclose(row[k], math.log(want), rel_tol=1e-9)
            assert math.isclose(back[head, k], want, rel_tol=1e-9)
    uses = lattice.expected(p, np.ones((len(words), 2)))
    lengths = np.array([len(x) for x in pieces])
    assert np.allclose((uses * lengths[:, None]).sum(0), sum(map(len, words)))


def test_words_of_any_length():
    rng = random.Random(8)
    pieces = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 30))) for _ in range(60)} | {b"a", b"b", b"c"})
    p = np.random.default_rng(2).random((len(pieces), 2)) / 50
    words = [b"".join(rng.choice(pieces) for _ in range(200))[:n] for n in (49, 64, 130, 300, 500)]
    lattice = Lattice(Pieces(pieces), _joined(words))
    got = lattice.log_probability(p)
    for w, row in zip(words, got):
        for k in range(2):
            of, sums = dict(zip(pieces, (Fraction(x) for x in p[:, k]))), [Fraction(1)]
            for end in range(1, len(w) + 1):
                sums.append(sum(sums[end - size] * of[w[end - size : end]] for size in range(1, min(end, 30) + 1) if w[end - size : end] in of))
            want = math.log(sums[-1].numerator) - math.log(sums[-1].denominator)
            assert math.isclose(row[k], want, rel_tol=1e-9)
    uses = lattice.expected(p, np.ones((len(words), 2)))
    lengths = np.array([len(x) for x in pieces])
    assert np.allclose((uses * lengths[:, None]).sum(0), sum(map(len, words)))
    # portions of short and long words give each word what it has by itself
    scorer = Scorer(Model(["x", "y"], pieces, p))
    every = [*words, b"abc", b"", b"cab" * 3, b"a" * 48]
    body, offsets = _joined(every)
    alone = [Lattice(Pieces(pieces), _joined([w])).log_probability(p)[0] for w in every]
    assert np.allclose(scorer.words(body, offsets[:-1], offsets[1:]), alone)


def test_letters_are_those_of_category_l(spark):
    rows = [(1, "½"), (2, "² ²"), (3, "Ⅷ"), (4, "ª"), (5, "１２"), (6, "x½"), (7, "你好世界" * 200), (8, "_ 7")]
    model = fit(spark.createDataFrame([(1, "the cat", "en"), (2, "le chat", "fr"), (3, "你好 世界", "zh")], "doc_id long, text string, lang string"), queries.piece_bpe())
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[k] == ("und", 0.0) for k in (1, 2, 3, 5, 8)) and all(got[k][0] != "und" for k in (4, 6)) and got[7][0] == "zh"


def test_many_languages(spark):
    rows = [(k, f"word{k} " * 3, f"l{k:04}") for k in range(505)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4), queries.piece_bpe(), rounds=1)
    assert len(model.langs) == 505


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op6_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    held = [r for r in got if r.held_out and r.lang is not None]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_nulls_empty_long_and_clashing(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, "le chat et le chien", "fr", 2), (None, None, None, 3), (4, "", "en", 4), (5, "12 !?", None, 5), (6, "the " * 50_000, None, 6), (6, "x" * 100_000, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int").withColumn("c0", F.lit("kept"))
    model = fit(df, queries.piece_bpe())
    got = predict(df, model).collect()
    assert [r.lang_pred for r in got][:3] == ["en", "fr", "und"] and [r.lang_pred for r in got if r.n in (4, 5)] == ["und"] * 2
    assert all(r.c0 == "kept" for r in got) and len(got) == 7 and {r.lang_pred for r in got if r.n == 6} <= {"en", "fr"}
    assert fit(df.limit(0), queries.piece_bpe()) is None
    assert {r.lang_pred for r in predict(df, None).collect()} == {"und"}
    assert isinstance(model, Model) and predict(df.limit(0), model).count() == 0


def test_a_rare_language_keeps_its_words_beside_large_ones(spark):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(7))
    texts = [" ".join(word("abcdefgh") for _ in range(4000)) for _ in range(15)] * 2 + [" ".join(word("abcdefgh") for _ in range(4000)) for _ in range(13)]
    rare = [" ".join(word("qrstuvwx") for _ in range(60))]
    rows = [(k, t, "aa") for k, t in enumerate(texts)] + [(1000, rare[0], "zz")]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), queries.piece_bpe())
    assert model.langs == ["aa", "zz"]
    for k, held in enumerate((texts, rare)):
        counts = Counter(w.encode() for t in held for w in words_of(t))
        want = _maximise(model.pieces, list(counts), np.array([*counts.values()], float)[:, None], 3)
        assert np.allclose(model.p[:, k], want[:, 0], rtol=1e-9, atol=0)
    fresh = [(1, " ".join(word("qrstuvwx") for _ in range(30))), (2, " ".join(word("abcdefgh") for _ in range(30)))]
    got = {r.doc_id: r.lang_pred for r in predict(spark.createDataFrame(fresh, "doc_id long, text string"), model).collect()}
    assert got == {1: "zz", 2: "aa"}
