"""Sessions of the funnel as streaming state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.funnel import fold_answers
from .ledger import Ledger
from .phrases import started


def fold_to(answers: DataFrame, path: str, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Keep the state of every session of a stream of answers (session, step, event, value) in a ledger's folder.

    The state is a handful of maxima a session, kept in Spark's state store; answers may come late and in any order.
    A batch writes the sessions that it changed.
    """
    return started(fold_answers(answers), Ledger(answers.sparkSession, path).take, checkpoint, trigger, "update")


def read_sessions(answers: DataFrame, path: str) -> DataFrame:
    """The state of each session, as fold_answers() gives it, after all batches so far."""
    spark = answers.sparkSession
    schema = fold_answers(spark.createDataFrame([], answers.schema)).schema
    rows = Ledger(spark, path).read(schema)
    fields = [c for c in schema.names if c != "session"]
    return rows.groupBy("session").agg(F.max_by(F.struct(*fields), "batch").alias("last")).select("session", "last.*")
