"""Targets, schedule and mix against plain loops."""

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from matchloom.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > most * sizes[s]]
        if not over:
            return fixed | {s: rest * weight[s] / w for s in free}
        fixed |= {s: most * sizes[s] for s in over}


def table(spark):
    rows = [(k, "w " * (k % 37) + "end", "abcde"[k % 5] if k % 7 else "a", k) for k in range(400)]
    rows += [(1000, None, "b", 1), (1001, "", "b", 1), (1002, "one two", None, 1), (None, "x y z", "c", 1), (1003, "same", "d", 1), (1003, "same", "d", 1), (1004, "  ", "empty", 1), (1005, "lone", "z", 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, target int")


def test_taken(spark):
    rows, df = table(spark)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = defaultdict(int)
    for _, text, source, _ in rows:
        per[source] += size(text)
    want = plain_targets(per)
    got = mixing.taken(df, block_words=64).collect()
    assert len(got) == len(rows)
    source_of = {r[0]: r[2] for r in rows}
    sums = defaultdict(int)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == per[s] and abs(r.target - want[s]) < 1e-6 and r.taken <= 3 * r.size
        sums[s] += r.taken
    assert all(sums[s] == int(want[s] + 1e-9) for s in per)
    assert sorted(mixing.taken(df.repartition(7), block_words=64).collect(), key=str) == sorted(got, key=str)
    assert mixing.taken(df.limit(0)).count() == 0


def test_schedule_is_spread_and_whole(spark):
    _, df = table(spark)
    tape, wanted = mixing.prepared(df)
    slots = mixing.schedule(wanted, 16).collect()
    need = {r.source_no: -(-int(r.target) // 16) for r in wanted.collect()}
    by = defaultdict(list)
    for r in sorted(slots, key=lambda r: r.slot):
        by[r.source_no].append(r.rank)
    assert {k: sorted(v) for k, v in by.items()} == {k: list(range(n)) for k, n in need.items() if n}
    assert len({r.slot for r in slots}) == len(slots)
    # the first slots already hold each source by its share, to within the sequence's discrepancy
    early = [r.source_no for r in sorted(slots, key=lambda r: r.slot)[: len(slots) // 2]]
    for k, n in need.items():
        assert abs(early.count(k) - n / 2) < 6
    mixed = mixing.mix(tape, wanted, 16).collect()
    assert all(0 < r.n_words <= 16 for r in mixed)
    u = mixing.golden_points(0, 1000) / 2.0**64
    assert max(np.diff(np.sort(u))) < 3 / 1000


def test_the_schedule_decides_the_order(spark):
    rows, df = table(spark)
    golden, other = ({(r.doc_id, r.size, r.first_slot, r.last_slot) for r in mixing.taken(df, block_words=16, sequence=q).collect()} for q in ("golden", "van_der_corput"))
    assert golden != other and {x[:2] for x in golden} == {x[:2] for x in other}
    bits = mixing.van_der_corput_points(0, 8) >> np.uint64(61)
    assert bits.tolist() == [0, 4, 2, 6, 1, 5, 3, 7]
    # any beginning of the written mix has the sources in their shares
    tape, wanted = mixing.prepared(df)
    names = {r.source: r.target for r in wanted.collect()}
    total = sum(int(t) for t in names.values())
    for sequence in ("golden", "van_der_corput"):
        words, seen = defaultdict(int), 0
        for r in mixing.mixed_documents(df, block_words=16, sequence=sequence).collect():
            n = len((r.text or "").split())
            words[r.source] += n
            seen += n
            if seen > 200:
                assert all(abs(words[s] - seen * t / total) <= 6 * 16 + 38 for s, t in names.items())


def test_rows_without_ids_are_spread(spark):
    df = spark.createDataFrame([(None, f"text {k} of many", "a") for k in range(3000)], "doc_id long, text string, source string")
    tape, _ = mixing.prepared(df)
    parts = tape.groupBy(F.substring("mixed", 1, 3)).count().agg(F.max("count")).first()[0]
    assert parts < 20


def test_mixed_documents(spark):
    rows, df = table(spark)
    out = mixing.mixed_documents(df, block_words=64)
    assert out.columns == df.columns
    count = {tuple(r[:4]): n for *r, n in out.groupBy(*df.columns).count().collect()}
    assert set(count) <= set(rows)
    got = {tuple(r): n for *r, n in mixing.taken(df, block_words=64).groupBy("doc_id").agg(F.sum("size"), F.sum("taken")).select("doc_id", F.col("sum(size)"), F.col("sum(taken)")).collect()}
    for (doc, size), took in got.items():
        copies = sum(n for r, n in count.items() if r[0] == doc)
        if size:
            assert abs(copies * size / max(1, sum(r[0] == doc for r in rows)) - took) <= size
    assert mixing.mixed_documents(df.limit(0)).count() == 0
