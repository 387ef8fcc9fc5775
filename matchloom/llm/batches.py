"""Columns computed from Arrow batches and added to a table that is otherwise passed through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .memory import trimmed
from .storage import prepare


def add_columns(df: DataFrame, inputs: list[str], start: Callable[[], Callable[..., list[pa.Array]]], added: str) -> DataFrame:
    """df with the columns of a DDL string added.

    start() runs once in each task and gives a function from the input columns of a batch to the added
    ones. Every row stays. So does every column, even if some share a name (the first one is read), but a
    column of an added name gives way to the new one.
    """
    names, new = df.columns, T._parse_datatype_string(added)
    at = [names.index(c) for c in inputs]
    plain = [f"c{k}" for k in range(len(names) + len(new.names))]
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(plain, [*df.schema.fields, *new.fields])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *function(*(batch.column(k) for k in at))], names=plain)

    prepare(df.sparkSession)
    stay = [k for k, c in enumerate(names) if c not in new.names]
    kept = [plain[k] for k in stay] + plain[len(names) :]
    return df.toDF(*plain[: len(names)]).mapInArrow(trimmed(run), schema).select(*kept).toDF(*(names[k] for k in stay), *new.names)
