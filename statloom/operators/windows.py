"""Scores, sorts and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff_lag(df: DataFrame, keys: list[str], index: str, value: str, lag: int = 1, out: str = "diff") -> DataFrame:
    """x - x[lag] inside each series; series are already collapsed to one row per index."""
    w = Window.partitionBy(*keys).orderBy(index)
    return df.withColumn(out, F.col(value) - F.lag(value, lag).over(w))


def z_scores(df: DataFrame, cols: list[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / sd per column through a one-row broadcast, not a whole-table window."""
    consts = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in cols], *[F.stddev_samp(c).alias(f"__s_{c}") for c in cols])
    return (df.crossJoin(F.broadcast(consts))
            .withColumns({f"{c}{suffix}": F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")) for c in cols})
            .drop(*[f"__m_{c}" for c in cols], *[f"__s_{c}" for c in cols]))


def t_scores(df: DataFrame, col: str, out: str = "t") -> DataFrame:
    """z * sqrt(n-2) / sqrt(n-1-z^2)."""
    n = df.agg(F.count(col).alias("__n"))
    z = F.col(f"{col}__z")
    left = F.col("__n") - 1 - z * z
    return (z_scores(df, [col], "__z").crossJoin(F.broadcast(n))
            .withColumn(out, F.when(left > 0, z * F.sqrt(F.col("__n") - 2) / F.sqrt(left)))
            .drop(f"{col}__z", "__n"))


def order_columns(spec: list[str]) -> list[Column]:
    """``['-a', 'b']`` -> descending a, ascending b, nulls last either way."""
    return [F.col(s[1:]).desc_nulls_last() if s.startswith("-") else F.col(s).asc_nulls_last() for s in spec]


def sort_rows(df: DataFrame, spec: list[str]) -> DataFrame:
    return df.orderBy(*order_columns(spec))


def top_k(df: DataFrame, spec: list[str], k: int = 6) -> DataFrame:
    return df.orderBy(*order_columns(spec)).limit(k)


def split_flag(*keys: str, share: float = 0.75, seed: int = 1) -> Column:
    """Reproducible membership of the training part, from a hash of the row key."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)
