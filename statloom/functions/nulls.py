"""Null rules of the source analyses, spelled out as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def member(col: Column, values) -> Column:
    """Set membership that is false, never null, for a null value."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def not_member(col: Column, values) -> Column:
    """Complement of :func:`member`; null values are kept by a filter on it."""
    return ~member(col, values)


def guarded(agg: Column, col: Column, na: str = "poison") -> Column:
    """``na='poison'`` turns the aggregate null when any input is null."""
    if na == "skip":
        return agg
    return F.when(F.count(F.lit(1)) == F.count(col), agg)


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join in which a null key matches a null key; right copies of the keys go.

    ``keys`` holds names, or ``(left_name, right_name)`` pairs.
    """
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in keys]
    if not pairs:
        return left.crossJoin(right)
    renamed = right.withColumnsRenamed({r: f"__{r}" for _, r in pairs})
    cond = reduce(lambda a, b: a & b,
                  [left[l].eqNullSafe(renamed[f"__{r}"]) for l, r in pairs])
    return left.join(renamed, cond, how).drop(*[f"__{r}" for _, r in pairs])
