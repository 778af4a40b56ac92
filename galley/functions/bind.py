"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    A Python variable holding a Column is copied into the plan at each use, and inside a lambda it
    is computed again for every element; a lambda's own variable is neither.
    """
    return F.get(F.transform(F.array(value), body), 0)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters only read.

    A filter on a projected column moves below the projection and takes a copy of its expression
    along; behind a generator the column is a plain attribute. The outer form adds no filter of its
    own, and over an array of one element it yields each row once.
    """
    kept = [c for c in df.columns if c not in columns]
    one = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*kept, one.alias("_once")).select(*kept, "_once.*")
