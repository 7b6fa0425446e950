"""Keeping a costly expression from being computed more than once.

The optimizer moves a filter below the projection it tests and repeats the projected expression
there. An explode stops it: what the explode produces can only be tested after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, keep: list, value: Column, name: str) -> DataFrame:
    """Rows where ``value`` is not null, with the value computed once per row."""
    rows = df.select(*keep, F.explode_outer(F.array(value)).alias(name))
    return rows.filter(F.col(name).isNotNull())


def unroll(df: DataFrame, array: Column, keep: list, position: str, item: str) -> DataFrame:
    """``posexplode`` of a costly array.

    Outer, then filtered: for the plain form the optimizer adds a size check below the explode,
    which computes the array a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, item))
    return rows.filter(F.col(position).isNotNull())


def holds(value: Column, test: Callable[[Column], Column]) -> Column:
    """Boolean test of a value that the test mentions many times, evaluated once."""
    return F.exists(F.array(value), test)
