"""Matching of streams of phrases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import match
from ..sources.catalogue import Catalogue
from .ledger import Ledger


def started(stream: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str | None, trigger: dict, mode: str = "append") -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).foreachBatch(take)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def match_stream(phrases: DataFrame, catalogue: Catalogue, write: Callable[[DataFrame, int], None], checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Match a stream of phrases, batch by batch; write(results, batch_id) takes each batch's results.

    The tiers need more than a stream alone can do, so each micro-batch is matched as a table. A batch that
    is run again has the same id and the same results.
    """
    return started(phrases, lambda batch, number: write(match(batch, catalogue), number), checkpoint, trigger)


def match_to(phrases: DataFrame, catalogue: Catalogue, path: str, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Match a stream of phrases into a ledger's folder, each batch once; read_matched() reads it."""
    return match_stream(phrases, catalogue, Ledger(phrases.sparkSession, path).take, checkpoint, **trigger)


def read_matched(phrases: DataFrame, catalogue: Catalogue, path: str) -> DataFrame:
    """What match_to() has written so far, with batch. phrases: a table or stream with the columns of those matched."""
    spark = phrases.sparkSession
    schema = match(spark.createDataFrame([], phrases.schema), catalogue).schema
    return Ledger(spark, path).read(schema)
