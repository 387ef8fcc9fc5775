"""Round trips of hard conversations."""

import hashlib
import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.llm import chat
from matchloom.llm.chat import format_conversations, loss_text, parse

HARD = ["", None, "\\", "\\\\", "###", "####", "\\### Assistant: </turn> ok", " </turn>\n", "### user: x </turn>\n", "</turn", "a\\</turn>", "\\;", ":", ": ", "\n", "é😀 ###", "</turn></turn>", "\\\\###", "$1 \\1"]
SCHEMA = "conv_id long, turn long, role string, text string"


def check(spark, rows, extra=()):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit("x"))
    out = format_conversations(df).withColumns({"turns": parse(F.col("formatted")), "loss": loss_text(F.col("formatted"), F.col("loss_spans"))}).collect()
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t if t is not None else 0, r or "", x or ""))
    assert {r.conv_id for r in out} == set(convs) and all(r.exact for r in out)
    for r in out:
        want = [(role, text) for *_, role, text in sorted(convs[r.conv_id])]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        assert len(r.loss_spans) == sum(role == "assistant" for role, _ in want)
    return out


def test_hard_texts_and_roles(spark):
    rows = [(k, t, role, text) for k, text in enumerate(HARD) for t, role in enumerate(["user", "assistant", *HARD[:17]])]
    check(spark, rows, extra=("line", "source", "head", "body"))


def test_ties_repeats_nulls_and_long(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (None, None, None, None), (None, 1, "assistant", "x"), (2, 3, "assistant", "long ###" * 20_000), *[(3, k, "assistant", str(k)) for k in range(300)]]
    check(spark, rows)
    assert format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "\\"]), st.text(st.sampled_from(list("\\#</turn>: ;\nké")), max_size=24)), min_size=20, max_size=60))
def test_random(spark, turns):
    check(spark, [(k % 5, k, role, text) for k, (role, text) in enumerate(turns)])


def test_known_output(spark):
    out = check(spark, [(7, 0, "user", "hi"), (7, 1, "assistant", "\\### Assistant: </turn> ok")])[0]
    assert out.formatted == "### user: hi </turn>\n### assistant: \\\\\\### Assistant: \\</turn> ok </turn>\n"
    assert hashlib.sha256(out.loss.encode()).hexdigest() == hashlib.sha256(b"\\### Assistant: </turn> ok").hexdigest()
    assert random.Random(1).random() and out.loss_spans[0].start == len("### user: hi </turn>\n### assistant: ")


def test_what_the_comparison_finds_is_escaped(spark, monkeypatch):
    """Texts that are rendered as they are though they conflict: the comparison has them escaped."""
    monkeypatch.setattr(chat, "_reads_back", lambda text: F.lit(True))
    rows = [(k, t, role, text) for k, text in enumerate(HARD) for t, role in enumerate(["user", "assistant", "assistant"])]
    check(spark, rows + [(99, 0, "assistant", "plain"), (99, 1, "assistant", "a ### b"), (99, 2, "user", "\\###")])


def test_what_no_escape_mends_is_marked(spark, monkeypatch):
    monkeypatch.setattr(chat, "_reads_back", lambda text: F.lit(True))
    monkeypatch.setattr(chat, "escape", lambda text: text)
    out = {r.conv_id: r.exact for r in format_conversations(spark.createDataFrame([(1, 0, "user", "a </turn>\nb"), (2, 0, "user", "plain")], SCHEMA)).collect()}
    assert out == {1: False, 2: True}
