"""Registration of queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(tables)`` as a query; ``sql`` is its check, where SQL can express it."""

    def add(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = key, fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def r_many(c: Column | str, digits: int = 6) -> Column:
    """``r`` for results of very many rows: the same numbers, by whole-number arithmetic.

    ``round`` writes each number out in decimal.  Only numbers near a tie, or too large for the arithmetic to be sure,
    need that.
    """
    x, unit = F.col(c) if isinstance(c, str) else c, F.lit(10.0**digits)
    whole = F.floor(x * unit + F.lit(0.5)).cast("double")
    sure = (F.abs(x * unit) < 1e12) & (F.abs(x * unit - whole) < 0.499)
    return F.when(sure, whole / unit).otherwise(F.round(x, digits)) + F.lit(0.0)
