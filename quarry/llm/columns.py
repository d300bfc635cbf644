"""Keeping a table's own columns out of the way of an operator's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def hidden(docs: DataFrame, *more: Column) -> DataFrame:
    """The columns of ``docs`` as ``_0``, ``_1``, ..., and ``more``."""
    return docs.select(*(_quoted(c).alias(f"_{i}") for i, c in enumerate(docs.columns)), *more)


def shown(table: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of ``docs`` under their names again, some of them replaced."""
    return table.select(*(new.get(c, F.col(f"_{i}")).alias(c) for i, c in enumerate(docs.columns)))
