"""Line dedup against plain dictionaries, and the runs' levels."""

import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from matchloom.llm import line_dedup, queries
from matchloom.llm.line_dedup import LineRuns, dedup_lines, line_hash

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x).translate(LOW)
    held = defaultdict(set)
    for doc, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                held[k].add(float("-inf") if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        me = float("-inf") if doc is None else doc
        gone = [len(held[key(x)]) >= 5 and max(held[key(x)]) > me for x in lines]
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


def test_against_plain(spark):
    common = ["L" * 40, " \tÉ" + "x" * 39 + "\r", "  " + "short" * 7, "y" * 39, "Q" * 41 + "İ"]
    rows = [(k, "\n".join([common[j] for j in range(5) if (k >> j) & 1] + [f"own {k} " * 9] * (k % 3) + ["", common[k % 5].swapcase()])) for k in range(40)]
    rows += [(50, None), (51, ""), (None, "L" * 40), (39, rows[39][1]), (52, "\n"), (53, ("Z" * 50 + "\n") * 3000), (54, "z" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"at": F.lit(1), "keeper": F.lit(2), "key": F.lit("k")})
    got = sorted([tuple(r) for r in dedup_lines(df).collect()], key=repr)
    assert got == brute(rows)
    assert sorted([tuple(r) for r in dedup_lines(df, batches=7, fan_out=3).collect()], key=repr) == got
    assert dedup_lines(df.limit(0)).count() == 0


def test_repeated_ids_count_once(spark):
    rows = [(k, "w" * 45) for k in (1, 1, 2, 3, 4)] + [(k, "v" * 45) for k in (1, 2, 3, 4, 5, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in dedup_lines(df).collect()], key=repr)
    assert got == brute(rows) and sum(r[2] for r in got) == 4
    # as the registered SQL has it: rows that share an id are one document there
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[2] for r in con.sql(queries.ORACLES["op5_line_dedup"]).fetchall()}
    for doc, dropped in want.items():
        assert sum(r[2] for r in got if r[0] == doc) == dropped


def test_the_anti_join_decides(spark, monkeypatch):
    rows = [(k, "x" * 50 + f"\nown {k}") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([tuple(r) for r in dedup_lines(df).collect()], key=repr)
    assert got == brute(rows)
    monkeypatch.setattr(LineRuns, "fresh", lambda self, batch: batch)
    assert sorted([tuple(r) for r in dedup_lines(df).collect()], key=repr) != got


def test_runs(spark):
    runs = LineRuns(spark, fan_out=2)
    keeper, levels = {}, []
    for k in range(5):
        lines = [f"line {j}" for j in range(k, k + 10)]
        for x in lines:
            keeper.setdefault(x, 100 - k)
        batch = spark.createDataFrame([(x,) for x in lines], "x string").select(line_hash(F.col("x")).alias("h")).select("h.h1", "h.h2", F.lit(100 - k).cast("long").alias("keeper"))
        batch = spark.table(runs.buckets.write(batch))
        fresh = runs.fresh(batch)
        assert fresh.count() == (10 if k == 0 else 1)
        assert "Exchange" not in fresh._jdf.queryExecution().executedPlan().toString()
        runs.add(batch)
        levels.append(len(runs.names))
    assert levels == [1, 1, 2, 1, 2]
    assert sorted(r.keeper for r in runs.lines().collect()) == sorted(keeper.values())


def test_a_failed_run_leaves_no_tables(spark, monkeypatch):
    def lost(self, names):
        raise RuntimeError("lost")

    before = {t.name for t in spark.catalog.listTables()}
    rows = spark.createDataFrame([(k, "the same line that is long enough to count as one here") for k in range(8)], "doc_id long, text string")
    with monkeypatch.context() as m:
        m.setattr(line_dedup.LineRuns, "_merged", lost)
        with pytest.raises(RuntimeError):
            line_dedup.dedup_lines(rows)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert line_dedup.dedup_lines(rows).filter("n_dropped = 1").count() == 7
    assert {t.name for t in spark.catalog.listTables()} == before
