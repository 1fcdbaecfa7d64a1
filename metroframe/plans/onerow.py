"""Use of one-row aggregates as scalar subqueries: no join, computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_row(df: DataFrame) -> Column:
    """A struct column with the single row of ``df``."""
    return df.select(F.struct(*[F.col(c) for c in df.columns])).scalar()


def beside(df: DataFrame, *others: DataFrame) -> DataFrame:
    """Columns of one-row tables added to every row of ``df``."""
    for i, other in enumerate(others):
        df = df.withColumn(f"_one{i}", one_row(other))
        df = df.select(*[c for c in df.columns if c != f"_one{i}"], f"_one{i}.*")
    return df
