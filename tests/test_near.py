"""Near keys against all pairs, with any threshold, index size and column names."""

import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from matchloom.operators import near
from matchloom.operators.categories import category_index, contained, grouped_index, resolve_categories
from matchloom.operators.funnel import answered, fold_answers, funnel
from matchloom.operators.matching import Asked, match
from matchloom.operators.near import NearIndex, may_be_deep, near_keys
from matchloom.sources.catalogue import Catalogue, parse_text
from tests.catalogues import MIRRORS
from tests.test_matching import alike

INDEX = "key string, key_ord int, tier int"


def all_pairs(keys, asked):
    out = {}
    for key, t in asked:
        hits = [(3 + n % 2, alike(key, k), k) for n, k in enumerate(keys) if alike(key, k) >= t]
        best = min(((tier, -score) for tier, score, _ in hits), default=None)
        if best:
            out[key, repr(t)] = {h for h in hits if (h[0], -h[1]) == best}
    return out


def gathered(rows):
    out = {}
    for r in rows:
        out.setdefault((r.key, repr(r.threshold)), []).append((r.tier, r.score, r.found))
    assert all(len(v) == len(set(v)) for v in out.values())
    return {k: set(v) for k, v in out.items()}


def words_of(seed, n, longest, letters="abcdeü "):
    rng = random.Random(seed)
    keys = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))).strip() or "x" for _ in range(n)})
    asked = []
    for _ in range(n):
        k = list(rng.choice(keys))
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            k[rng.randrange(len(k)) : 0] = rng.choice(letters)
            del k[rng.randrange(len(k))]
        asked.append(("".join(k) + rng.choice(["", "a", "dede"]), rng.choice([0.9, 0.8, 0.6, 0.5, 0.3, 0.1, 0.0, -1.0])))
    return keys, asked


@pytest.mark.parametrize(("seed", "longest", "blocks", "broadcast"), [(1, 12, 50_000, 200_000), (2, 60, 40, 200_000), (3, 40, 25, 0)])
def test_any_threshold_against_all_pairs(spark, monkeypatch, seed, longest, blocks, broadcast):
    monkeypatch.setattr(near, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(near, "BROADCAST_ROWS", broadcast)
    keys, asked = words_of(seed, 120, longest)
    odd = [1e-20, 1e-300, 5e-324, 1.0, 2.0, math.nan, math.inf, -math.inf, 0.999999]
    asked = list({(k, repr(t)): (k, t) for k, t in [*asked, *((keys[7] + "z", t) for t in odd), ("", 0.5), ("", 0.0), ("", 1e-300), (keys[3], 0.9), (keys[3], 0.0), ("q" * 300, 0.0), ("q" * 300, 0.9)]}.values())
    index = NearIndex(spark.createDataFrame([(k, n, 3 + n % 2) for n, k in enumerate(keys)], INDEX))
    pairs = spark.createDataFrame(asked, "key string, threshold double")
    assert gathered(near_keys(pairs, index).collect()) == all_pairs(keys, asked)
    assert may_be_deep(pairs, F.col("key"), F.col("threshold"), index)


def test_high_thresholds_need_no_deepening(spark):
    keys, _ = words_of(4, 150, 20)
    asked = sorted({(k[:-1] + "a", 0.85) for k in keys})
    index = NearIndex(spark.createDataFrame([(k, n, 3 + n % 2) for n, k in enumerate(keys)], INDEX))
    pairs = spark.createDataFrame(asked, "key string, threshold double")
    assert not may_be_deep(pairs, F.col("key"), F.col("threshold"), index)
    assert gathered(near_keys(pairs, index, False).collect()) == all_pairs(keys, asked)


def test_names_that_share_most_of_their_letters(spark, tmp_path, monkeypatch):
    keys = [f"customer#{n:09d} {'machinery' if n % 2 else 'furniture'}" for n in range(600)]
    asked = [(k[1:] + "x", 0.85) for k in keys[::60]] + [(keys[77][:9] + keys[77][11:], 0.9), (keys[78].replace("c", "k").replace("t", "d"), 0.8), ("customer#00000 furni", 0.6), ("q" * 28, 0.85)]
    monkeypatch.setattr(near, "BROADCAST_ROWS", 0)
    NearIndex(spark.createDataFrame([(k, n, 3 + n % 2) for n, k in enumerate(keys)], INDEX)).save(f"file://{tmp_path}/names", 3)
    index = NearIndex.load(spark, f"file://{tmp_path}/names")
    pairs = spark.createDataFrame(asked, "key string, threshold double")
    assert gathered(near_keys(pairs, index).collect()) == all_pairs(keys, asked)
    high = pairs.filter("threshold >= 0.85")
    lazy = near_keys(high, index, False)
    assert gathered(lazy.collect()) == all_pairs(keys, [a for a in asked if a[1] >= 0.85])
    assert "SelectedBucketsCount: 3 out of 3" in lazy._jdf.queryExecution().executedPlan().toString()
    # a piece of equal length is one that all keys share; one cut by rarity is not
    shared = lambda df, *by: df.groupBy(*by).count().agg(F.max("count")).first()[0]
    assert shared(index.pieces.filter("e = 2"), "piece", "part") == len(keys)
    assert shared(index.rare(), "slot") <= len(keys) // 4


def test_empty_index(spark):
    index = NearIndex(spark.createDataFrame([], INDEX))
    assert near_keys(spark.createDataFrame([("a", 0.0)], "key string, threshold double"), index).count() == 0


@pytest.mark.parametrize("buckets", [None, 3])
def test_saved_index_and_catalogue(spark, tmp_path, monkeypatch, buckets):
    catalogue = parse_text(spark, MIRRORS)
    catalogue.save(f"file://{tmp_path}/c", buckets)
    again = Catalogue.load(spark, f"file://{tmp_path}/c")
    assert again.sizes() == catalogue.sizes() and again.near.sizes() == catalogue.near.sizes()
    rows = spark.createDataFrame([(1, "yan guzgu", 0.7), (2, "traves", 0.9), (3, "fara", 0.0), (4, "zzz", 0.4)], "qid long, phrase string, threshold double")
    want = {r.qid: r.result for r in match(rows, catalogue).collect()}
    monkeypatch.setattr(near, "BROADCAST_ROWS", 0)
    assert {r.qid: r.result for r in match(rows, again).collect()} == want
    if buckets:  # the pieces are joined as they lie
        plan = near_keys(Asked(rows, "phrase").pairs(), again.near, False)._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan


def test_any_column_stays(spark):
    catalogue = parse_text(spark, MIRRORS).persist()
    index = category_index(catalogue)
    clash = ["score", "tier", "parts", "result", "categories", "key", "found", "restrict", "category_result", "next_question", "phrase_", "said_category", "_0_", "n", "e", "part_id"]
    rows = spark.createDataFrame([(1, "traves", "s", *range(len(clash))), (2, "emblema", "t", *range(len(clash)))], "qid long, phrase string, session string, " + ", ".join(f"{c} int" for c in clash))
    rows = rows.select("*", "n", "key")  # and names that are there twice
    state = fold_answers(spark.createDataFrame([("s", 1, "part", "AS-017")], "session string, step int, event string, value string"))
    for out, new in (
        (match(rows, catalogue), {"result", "tier"}),
        (resolve_categories(rows.withColumnRenamed("phrase", "word"), index), {"result"}),
        (funnel(rows, catalogue, index), {"category_result", "result", "tier", "next_question"}),
        (answered(rows, catalogue, state, index), {"category_result", "result", "tier", "chosen", "next_question"}),
    ):
        kept = [k for k, c in enumerate(clash) if c not in new]
        for row in out.collect():
            assert [row[c] for c in (clash[k] for k in kept)] == kept and row.qid in (1, 2)
            assert [(c, x) for c, x in zip(out.columns, row) if c in ("n", "key")] == [(c, clash.index(c)) for c in ("key", "n", "n", "key")]
        assert all(out.columns.count(c) == 1 for c in new)
    plain = rows.select("qid", "phrase")
    assert {r.qid: r.result for r in match(rows, catalogue).collect()} == {r.qid: r.result for r in match(plain, catalogue).collect()}
    catalogue.unpersist()


def test_containment_looks_up_the_rarest_trigram(spark):
    rng = random.Random(9)
    keys = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(200)} | {f"the{k}xq{k}" for k in range(100)})
    index = spark.createDataFrame([(k, f"c{n % 7}") for n, k in enumerate(keys)], "key string, category string")
    asked = sorted({k[rng.randint(0, 2) :][: rng.randint(2, 6)] for k in keys} | {"the", "the7x", "zzz", "ab", "", "thexq"})
    got = {r.key: r.contained for r in contained(spark.createDataFrame([(a,) for a in asked], "key string"), grouped_index(index), 10_000).collect()}
    of = dict(index.collect())
    want = {a: sorted({of[k] for k in keys if a in k}) for a in asked if len(a) >= 3}
    assert got == {a: c for a, c in want.items() if c}


def test_a_hundred_thousand_names(spark, tmp_path):
    """Names of part, supplier and customer; keys asked with a distance of up to three, against all pairs in DuckDB."""
    sf = "/root/testdata/sf0.1"
    one = spark.read.parquet(f"{sf}/part.parquet").select(F.concat_ws(" ", "p_name", "p_brand", "p_partkey").alias("name"), F.col("p_partkey").alias("id"))
    two = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat_ws(" ", F.lower("s_name"), "s_suppkey").alias("name"), F.col("s_suppkey").alias("id"))
    three = spark.read.parquet(f"{sf}/customer.parquet").select(F.concat_ws(" ", F.lower("c_name"), F.lower("c_mktsegment")).alias("name"), F.col("c_custkey").alias("id"))
    base = one.unionByName(two).unionByName(three)
    named = base.select("id", F.explode(F.array("name", F.concat("name", F.lit(" new")), F.concat(F.lit("old "), "name"))).alias("name")).distinct()
    path = f"{tmp_path}/names"
    named.write.parquet(f"file://{path}")
    named = spark.read.parquet(f"file://{path}")
    assert named.count() >= 100_000
    index = NearIndex(named.select(F.lower("name").alias("key"), F.lit(0).alias("key_ord"), F.lit(3).alias("tier")).distinct())
    index.save(f"file://{path}-index", 4)
    index = NearIndex.load(spark, f"file://{path}-index")
    asked = named.filter("id % 2500 = 0").select(F.concat(F.expr("substring(lower(name), 2)"), F.lit("x")).alias("key"), F.lit(0.88).alias("threshold")).distinct()
    got = {(r.key, r.found, round(r.score, 9)) for r in near_keys(asked, index, False).collect()}
    con = duckdb.connect()
    want = con.sql(f"""WITH k AS (SELECT DISTINCT lower(name) AS found FROM '{path}/*.parquet'),
        a AS (SELECT DISTINCT substr(lower(name), 2) || 'x' AS key FROM '{path}/*.parquet' WHERE id % 2500 = 0),
        s AS (SELECT key, found, 1.0::DOUBLE - levenshtein(key, found)::DOUBLE / greatest(length(key), length(found)) AS score FROM a, k WHERE abs(length(key) - length(found)) <= 6)
        SELECT key, found, round(score, 9) FROM s WHERE score >= 0.88 QUALIFY rank() OVER (PARTITION BY key ORDER BY score DESC) = 1""").fetchall()
    assert got == set(want) and len(got) >= asked.count() // 2
    # rows met for each pair, of 100,000 keys
    plan = near._probed(near._banded(asked, *index.sizes()[1:3]).withColumn("e", F.explode(F.sequence(near._edits(F.col("n"), F.col("threshold")), F.col("most")))), index.pieces, index.sizes()[3], True)
    print(json.dumps({"pairs": asked.count(), "met": plan.count(), "keys": index.sizes()[0]}))
