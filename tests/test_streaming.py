"""Streams against batches, with drivers lost between any two steps."""

import random

import pytest

from matchloom.operators.funnel import EVENTS, fold_answers
from matchloom.operators.matching import match
from matchloom.sources.catalogue import parse_text
from matchloom.streaming.ledger import Ledger
from matchloom.streaming.phrases import match_to, read_matched
from matchloom.streaming.sessions import fold_to, read_sessions
from tests.catalogues import MIRRORS


class Lost(Exception):
    pass


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


@pytest.mark.parametrize("step", ["write_rows", "enter", "after"])
def test_matched_once_whatever_is_lost(spark, tmp_path, monkeypatch, step):
    catalogue = parse_text(spark, MIRRORS)
    texts = ["traves", "yan güzgü", "fara", "zzz", "stupitsa podsipniki", "traves"]
    rows = spark.createDataFrame(list(enumerate(texts)), "qid long, phrase string")
    rows.repartition(3, "qid").write.json(f"file://{tmp_path}/in")
    at = dict(path=f"file://{tmp_path}/out", checkpoint=f"file://{tmp_path}/checkpoint")
    real = Ledger.take

    def lossy(self, batch, number):
        if number == 1 and step == "write_rows":  # part of the batch is written, and its folder is not whole
            self.write_rows(batch.limit(1), number)
            raise Lost
        if number == 1 and step == "enter":
            self.write_rows(batch, number)
            raise Lost
        real(self, batch, number)
        if number == 1:  # entered, but the stream has not noted it
            raise Lost

    monkeypatch.setattr(Ledger, "take", lossy)
    with pytest.raises(Exception, match="Lost"):
        match_to(stream_of(spark, f"file://{tmp_path}/in", rows.schema), catalogue, **at).awaitTermination()
    assert Ledger(spark, at["path"]).entered() == ([0, 1] if step == "after" else [0])
    before = read_matched(rows, catalogue, at["path"]).count()
    monkeypatch.setattr(Ledger, "take", real)
    match_to(stream_of(spark, f"file://{tmp_path}/in", rows.schema), catalogue, **at).awaitTermination()
    got = read_matched(rows, catalogue, at["path"])
    assert before < got.count() == len(texts)
    assert sorted((r.qid, r.result) for r in got.collect()) == sorted((r.qid, r.result) for r in match(rows, catalogue).collect())
    match_to(stream_of(spark, f"file://{tmp_path}/in", rows.schema), catalogue, **at).awaitTermination()  # nothing new
    assert read_matched(rows, catalogue, at["path"]).count() == len(texts)


def test_nothing_matched_yet(spark, tmp_path):
    rows = spark.createDataFrame([], "qid long, phrase string")
    assert read_matched(rows, parse_text(spark, MIRRORS), f"file://{tmp_path}/none").count() == 0


def test_sessions_are_the_fold_of_every_prefix(spark, tmp_path):
    rng = random.Random(5)
    schema = "session string, step int, event string, value string"
    steps = rng.sample(range(90), 90)  # answers come in any order
    answers = [(rng.choice("abcd"), n, rng.choice(EVENTS), f"v{n}") for n in steps]
    path, at = f"file://{tmp_path}/state", f"file://{tmp_path}/checkpoint"
    for k in range(3):
        spark.createDataFrame(answers[30 * k : 30 * k + 30], schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/in")
        fold_to(stream_of(spark, f"file://{tmp_path}/in", schema), path, at).awaitTermination()
        sofar = spark.createDataFrame(answers[: 30 * k + 30], schema)
        assert sorted(map(tuple, read_sessions(sofar, path).collect())) == sorted(map(tuple, fold_answers(sofar).collect()))
