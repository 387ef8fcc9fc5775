"""The automaton against a plain greedy longest match."""

import json
import random

import public_tokenizers

from matchloom.llm.token_counts import _END, Automaton, Counter, count_tokens, pieces_of

PATH = public_tokenizers.path("word_bpe_49k.json")


def greedy(word, pieces, end):
    rest, n, longest = (*word, *end), 0, max(map(len, pieces))
    while rest:
        for k in range(min(longest, len(rest)), 0, -1):
            if rest[:k] in pieces:
                rest, n = rest[k:], n + 1
                break
        else:
            return 0
    return n


def test_automaton_equals_greedy_on_random_vocabularies():
    rng = random.Random(5)
    for _ in range(300):
        pieces = {tuple(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) + ((_END,) if rng.random() < 0.3 else ()) for _ in range(rng.randint(1, 14))}
        auto = Automaton(sorted(pieces))
        end = (_END,) * bool(auto.end)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
            assert auto.count(word) == greedy(word, pieces, end), (pieces, word)


def test_counts_of_whole_tables(spark, sf_dir):
    with open(PATH, encoding="utf-8") as f:
        pieces = set(pieces_of(json.load(f)["model"]["vocab"]))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in count_tokens(docs, PATH).collect()}
    c, known = Counter(PATH), {}
    letters = {v: k for k, v in c.letters.items()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        words = c.model.pre_tokenizer.pre_tokenize_str(c.model.normalizer.normalize_str(r.text or ""))
        words = [bytes(c.letters[x] for x in w) for w, _ in words]
        for w in words:
            if w not in known:
                known[w] = greedy(w, pieces, (_END,))
        assert (got[r.doc_id].n_words, got[r.doc_id].n_tokens) == (len(words), sum(known[w] or 1 for w in words))
    assert len(letters) == 256


def test_another_tokenizer_file():
    path = public_tokenizers.path("byte_bpe_50k.json")
    c, text = Counter(path), "Don't  stop 12 é\n"
    with open(path, encoding="utf-8") as f:
        pieces = set(pieces_of(json.load(f)["model"]["vocab"], ""))
    words = [bytes(c.letters[x] for x in w) for w, _ in c.model.pre_tokenizer.pre_tokenize_str(text)]
    assert c.words(text) == words and c.count(text)[:2] == (len(words), sum(greedy(w, pieces, ()) for w in words))


def test_nulls_odd_texts_and_clashing_columns(spark):
    rows = [(1, None, 1), (2, "", 2), (None, "don't İstanbul 東京 ½ é <|endoftext|>", 3), (3, "x" * 200_000, 4), (3, "x" * 200_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = count_tokens(df, PATH).collect()
    assert len(got) == 5 and all(r.n_tokens == 0 for r in got if r.doc_id in (1, 2))
    assert count_tokens(df.limit(0), PATH).count() == 0
