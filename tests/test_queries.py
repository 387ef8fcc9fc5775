"""Registered queries of the engine against their SQL, on the smallest tables."""

import os
import subprocess
import sys

import duckdb
import pytest

from matchloom.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, sql, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name in ORACLES:
        want = sql.sql(ORACLES[name])
        names = sorted(df.columns)
        assert sorted(want.columns) == names
        at = [want.columns.index(c) for c in names]
        assert plain([r[c] for c in names] for r in rows) == plain([r[k] for k in at] for r in want.fetchall())
    spark.catalog.clearCache()


HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in {hidden!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__
print(*sorted(__spark_entry__.queries()))
assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
"""


@pytest.mark.parametrize("hidden", [("matchloom.llm",), ("corpus_pipeline",), ("matchloom.llm", "corpus_pipeline", "public_tokenizers")])
def test_entry_without_the_corpus_operators(hidden):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", HIDE.format(hidden=hidden)], cwd=root, capture_output=True, text=True, check=True)
    assert set(done.stdout.split()) == set(QUERIES)


def test_entry_takes_in_all_queries():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
