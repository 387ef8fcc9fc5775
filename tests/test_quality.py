"""Fingerprints and changes of tables against comparing all rows."""

import random
from collections import Counter

import pytest

from matchloom.operators.quality import changes, fingerprints, stale, staleness

SCHEMA = "key string, other int, value string"


def brute(held, fresh):
    of = lambda rows: {k: Counter(r for r in rows if r[:2] == k) for k in {r[:2] for r in rows}}
    old, new = of(held), of(fresh)
    return sorted([(*k, "added" if k not in old else "lost" if k not in new else "changed") for k in {*old, *new} if old.get(k) != new.get(k)], key=repr)


@pytest.mark.parametrize(("seed", "buckets"), [(1, 4096), (2, 1), (3, 7)])
def test_changes(spark, seed, buckets):
    rng = random.Random(seed)
    row = lambda: (rng.choice([None, "", *"abcdef"]), rng.choice([None, 1, 2]), rng.choice([None, "", "x", "y"]))
    held = [row() for _ in range(40)]
    fresh = rng.sample(held, 34) + [row() for _ in range(4)] + [held[0]]
    one, other = spark.createDataFrame(held, SCHEMA), spark.createDataFrame(fresh, SCHEMA).select("value", "key", "other")
    assert sorted([tuple(r) for r in changes(one, other, ["key", "other"], buckets).collect()], key=repr) == brute(held, fresh)
    again = spark.createDataFrame(rng.sample(held, len(held)), SCHEMA)
    assert changes(one, again, ["key", "other"], buckets).count() == 0 and not stale(one, again) and stale(one, other)
    assert staleness(one, again, ["key"], buckets).first().asDict() == {"stale": False, "differing": 0}


def test_fingerprints_tell_rows_apart(spark):
    one = lambda *rows: [tuple(r)[1:] for r in fingerprints(spark.createDataFrame(list(rows), SCHEMA), ["key"], 1).collect()]
    tables = [one(("a", 1, "x")), one(("a", 1, "x"), ("a", 1, "x")), one(("a", 1, "")), one(("a", 1, None)), one(("a", None, None)), one(("ax", 1, "")), one(("a", 1, "x"), ("a", 1, "x"), ("a", 1, "x"))]
    assert len({repr(t) for t in tables}) == len(tables)
    empty = spark.createDataFrame([], SCHEMA)
    assert not stale(empty, empty) and [tuple(r) for r in changes(empty, spark.createDataFrame([("a", 1, None)], SCHEMA), ["key"]).collect()] == [("a", "added")]
