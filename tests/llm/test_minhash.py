"""Signatures against their expectation, and classes against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from matchloom.llm import queries
from matchloom.llm.components import components
from matchloom.llm.minhash import _sign, classes, jaccard, keep_one, linked_in_block, near_duplicates, probability_jaccard, shingles, signatures
from matchloom.llm.textbytes import words_of


def sets_of(texts):
    out = []
    for t in texts:
        w = words_of(t)
        out.append({("whole", t)} if t is not None and not w else {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def test_shingles_and_similarity():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, "", "!!", "!!"]
    keys, text, counts = shingles(pa.array(texts))
    want = sets_of(texts)
    assert np.bincount(text, minlength=len(texts)).tolist() == [len(s) for s in want]
    left, right = texts[:-1], texts[1:]
    got = jaccard(pa.array(left), pa.array(right))
    for g, a, b in zip(got, sets_of(left), sets_of(right)):
        assert g == pytest.approx(len(a & b) / max(1, len(a | b)))


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 60).astype(np.uint64)
    x = {k: w for k, w in zip(keys[:45].tolist(), rng.integers(1, 6, 45))}
    y = {k: w for k, w in zip(keys[15:].tolist(), rng.integers(1, 6, 45))}
    every = [*x, *y]
    signed = signatures(np.array(every, np.uint64), np.repeat([0, 1], 45), np.array([*x.values(), *y.values()], float), 2, 4000)
    want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x.keys() & y.keys())
    assert (signed[0] == signed[1]).mean() == pytest.approx(want, abs=0.03)


def plain_probability(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x.keys() & y.keys())


def test_probability_jaccard():
    rng = random.Random(5)
    for _ in range(60):
        x, y = ({rng.randrange(30): rng.randint(1, 9) for _ in range(rng.randint(1, 25))} for _ in range(2))
        a, b = (sorted(z) for z in (x, y))
        got = probability_jaccard(np.array(a, np.uint64), np.array([x[k] for k in a]), np.array(b, np.uint64), np.array([y[k] for k in b]))
        assert got == pytest.approx(plain_probability(x, y))
        assert probability_jaccard(np.array(a, np.uint64), np.ones(len(a)), np.array(b, np.uint64), np.ones(len(b))) == pytest.approx(len({*a} & {*b}) / len({*a, *b}))


def test_weighted_classes(spark):
    words = [f"w{k}" for k in range(60)]
    head, tail = " ".join(words[:40]), " ".join(words[40:])
    texts = [f"{head} {tail}", f"{head} {tail} {tail}", " ".join([head] + [tail] * 30), " ".join([head] + [tail] * 31), " ".join([head] * 30 + [tail])]
    bags = [Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for w in map(words_of, texts)]
    want = {(a, b) for a in range(5) for b in range(a) if plain_probability(bags[a], bags[b]) >= 0.8}
    got = {r.doc_id: r.class_id for r in classes(near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), weights="count")).collect()}
    assert (3, 2) in want and (4, 2) not in want
    for a, b in want:
        assert got[a] == got[b]
    assert got[4] != got[2] and got[0] != got[2]
    plain = {r.doc_id: r.class_id for r in classes(near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert set(plain.values()) == {0}


def test_recall_on_the_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    got = {r.doc_id: r.class_id for r in queries.op8_minhash_near_dedup(spark, d).collect()}
    sets = sets_of([r.text for r in rows])
    postings = defaultdict(list)
    for k, own in enumerate(sets):
        for x in own:
            postings[x].append(k)
    links = found = 0
    for k, own in enumerate(sets):
        for j, common in Counter(j for x in own for j in postings[x] if j != k).items():
            if common >= 0.8 * (len(own) + len(sets[j]) - common):
                links += 1
                found += got[rows[k].doc_id] == got[rows[j].doc_id]
    assert links > 100 and found == links


def test_large_torn_buckets(spark):
    rng = random.Random(12)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for _ in range(420):  # near copies that are often no links of each other
        w = list(base)
        for at in rng.sample(range(120), rng.randint(0, 5)):
            w[at] = f"n{rng.randrange(10**6)}"
        rows.append(" ".join(w))
    rows = list(enumerate(rows))
    got = classes(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.class_id].append(r.doc_id)
    assert sorted(sorted(map(str, g)) for g in groups.values()) == all_pairs(rows)


def variants(rng, base, n):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        out.append(" ".join(w))
    return out


def all_pairs(rows):
    sets = sets_of([t for _, t in rows])
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if sets[a] and n >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    return sorted(sorted(map(str, g)) for g in groups.values())


def test_classes_against_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = [f"w{g}x{k}" for k in range(rng.choice([40, 80, 160]))]
        rows += variants(rng, base, 16)
    # a chain: each next to the last, its ends far apart
    base = [f"c{k}" for k in range(100)]
    for k in range(12):
        rows.append(" ".join(base[k * 4 : k * 4 + 60]))
    rows += ["one two", "One, two!", "", "", None, None, "!!", "long " * 30_000, "long " * 30_000]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, node string")
    got = classes(near_duplicates(df)).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r.class_id].append(r.doc_id)
    assert sorted(sorted(map(str, g)) for g in groups.values()) == all_pairs(rows)
    assert all(r.class_id == min(groups[r.class_id]) and r.class_size == len(groups[r.class_id]) for r in got)
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(groups)


def test_copies_with_a_line_repeated_many_times(spark):
    rows = []
    for g in range(80):
        base = [f"w{g}x{k}" for k in range(60)]
        a, z, times = [(0, 20, 50), (20, 40, 20), (40, 52, 50), (10, 30, 200)][g % 4]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:a] + base[a:z] * times + base[z:]))]
        a, b = sets_of([rows[-2][1], rows[-1][1]])
        assert len(a & b) >= 0.8 * len(a | b)
    # the same shingles, each as often as it likes: one node with one set of buckets
    ring = "a b c d e f g h "
    rows += [(200 + k, ring * (2 + 7 * k) + "a b c d") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.class_size) for r in classes(near_duplicates(df)).collect()}
    assert got == {k: (k - k % 2, 2) if k < 200 else (200, 6) for k, _ in rows}
    signed = list(_sign(28, 5, 5)(iter([pa.record_batch([pa.array([k for k, _ in rows]), pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text_hash", "text"])])))
    buckets = defaultdict(set)
    for batch in signed:
        for node, bands in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            buckets[node].add(tuple(bands))
    assert len(buckets) == 161 and all(len(b) == 1 for b in buckets.values())


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (5, "q w e r t y"), (6, None)], "doc_id long, text string")
    got = classes(near_duplicates(df)).collect()
    assert sorted((r.class_id, r.class_size) for r in got) == [(5, 1), (5, 3), (5, 3), (5, 3), (6, 1)]
    assert keep_one(df).count() == 3
    assert classes(near_duplicates(df.limit(0))).count() == 0 and keep_one(df.limit(0)).count() == 0


def test_blocks_find_links_between_classes():
    rng = random.Random(3)
    texts = variants(rng, [f"a{k}" for k in range(60)], 10) + variants(rng, [f"b{k}" for k in range(60)], 10)
    # every text asks, and every text is asked
    links = linked_in_block(pa.array(texts * 2), list(range(20)) * 2, [True] * 20 + [False] * 20, 0.8, 5)
    links = [(a % 20, b % 20) for a, b in links]
    root = list(range(20))
    for a, b in links:
        ra, rb = root[a], root[b]
        root = [ra if r == rb else r for r in root]
    groups = defaultdict(list)
    for k, r in enumerate(root):
        groups[r].append(k)
    assert sorted(sorted(map(str, g)) for g in groups.values()) == all_pairs(list(enumerate(texts)))


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5, 5)]
    root = {x: x for p in links for x in p}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[k] == find(k) for k in got) and {x for a, b in links if a != b for x in (a, b)} == set(got)


def test_words_of_a_regular_pattern_are_not_alike(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows = [(k, " ".join(f"{w}{x}" for x in range(20))) for k, w in enumerate((a, b, a[:100], b[:100], a[:8], b[:8]))]
    got = classes(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == [(k, k, 1) for k in range(6)]
