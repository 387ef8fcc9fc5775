"""Tables with any columns: an operator's own names never meet those of its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Apart:
    """A table under positional column names, and the way back to its own.

    A column is looked up by its name (the first, if several share it). The operator works with whatever
    other names it likes; put_back() gives the input's columns in their order, but for those that give way,
    and then the added ones.
    """

    def __init__(self, table: DataFrame):
        self.names = table.columns
        self.plain = table.toDF(*[f"_{k}_" for k in range(len(self.names))])

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def column(self, name: str) -> Column:
        return F.col(f"_{self.names.index(name)}_")

    def get(self, name: str, kind: str) -> Column:
        """A column as a type, or nulls where there is none of the name."""
        return self.column(name).cast(kind) if name in self else F.lit(None).cast(kind)

    def put_back(self, out: DataFrame, added: dict[str, str | None]) -> DataFrame:
        """added: new names, and the columns of out they are (None: that of the same name)."""
        stay = [k for k, c in enumerate(self.names) if c not in added]
        fresh = [F.col(c or name).alias(f"_new{k}_") for k, (name, c) in enumerate(added.items())]
        return out.select(*[f"_{k}_" for k in stay], *fresh).toDF(*(self.names[k] for k in stay), *added)
