"""Association of categorical columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.tails import chi2_p
from statloom.functions.vectors import vector_udf


def pair_counts(df: DataFrame, variables: dict[str, Column], target: Column) -> DataFrame:
    """Counts (variable, level, target) of many variables against one target, in one pass."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(n).alias("variable"), c.cast("string").alias("level")) for n, c in variables.items()]))
    return (df.select(target.cast("string").alias("target"), cells.alias("c")).select("c.*", "target")
            .dropna().groupBy("variable", "level", "target").agg(F.count(F.lit(1)).alias("n")))


def chi_square_from_counts(counts: DataFrame, key: str = "variable", row: str = "level", col: str = "target") -> DataFrame:
    """Per key: n, rows, cols, chi2, df.  Empty cells need no row: sum n^2/(r c) does not see them."""
    r = F.sum("n").over(Window.partitionBy(key, row))
    c = F.sum("n").over(Window.partitionBy(key, col))
    cells = counts.withColumns({"__r": r, "__c": c})
    stats = cells.groupBy(key).agg(
        F.sum("n").alias("n"), F.countDistinct(row).alias("rows"), F.countDistinct(col).alias("cols"),
        F.sum(F.col("n") * F.col("n") / (F.col("__r") * F.col("__c").cast("double"))).alias("__q"))
    return stats.select(key, "n", "rows", "cols", (F.col("n") * (F.col("__q") - 1)).alias("chi2"),
                        ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("df"))


def chi_square(df: DataFrame, variables: dict[str, Column], target: Column) -> DataFrame:
    out = chi_square_from_counts(pair_counts(df, variables, target))
    return out.withColumn("p_value", chi2_p("chi2", F.col("df").cast("double")))


def cramers_v(df: DataFrame, variables: dict[str, Column], target: Column) -> DataFrame:
    """V, its bias-corrected form, chi2 and df for every variable against the target."""
    t = chi_square_from_counts(pair_counts(df, variables, target))
    phi2 = F.try_divide(F.col("chi2"), F.col("n"))
    r, c, n1 = F.col("rows"), F.col("cols"), F.col("n") - 1
    phi2c = F.greatest(F.lit(0.0), phi2 - F.try_divide((r - 1) * (c - 1), n1))
    rc, cc = r - F.try_divide((r - 1) * (r - 1), n1), c - F.try_divide((c - 1) * (c - 1), n1)
    return t.withColumns({"v": F.sqrt(F.try_divide(phi2, F.least(r - 1, c - 1))),
                          "v_corrected": F.sqrt(F.try_divide(phi2c, F.nullif(F.greatest(F.least(rc - 1, cc - 1), F.lit(0.0)), F.lit(0.0))))})


def _fisher(a: int, b: int, c: int, d: int) -> float:
    """Sum of hypergeometric probabilities not above the observed one.

    Log weights are chained outward from the mode and kept to 50 standard deviations,
    past which they are below the smallest double.
    """
    r1, c1, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, r1 + c1 - n), min(r1, c1)
    mean = r1 * c1 / n if n else 0.0
    sd = np.sqrt(max(mean * (n - r1) / n * (n - c1) / max(n - 1, 1), 1.0)) if n else 1.0
    first, last = max(lo, int(mean - 50 * sd) - 50), min(hi, int(mean + 50 * sd) + 50)
    if not first <= a <= last:
        return 0.0
    k = np.arange(first, last, dtype=float)
    steps = np.log(r1 - k) + np.log(c1 - k) - np.log(k + 1) - np.log(n - r1 - c1 + k + 1)
    logw = np.concatenate([[0.0], np.cumsum(steps)])
    w = np.exp(logw - logw.max())
    return float(min(1.0, w[w <= w[a - first] * (1 + 1e-7)].sum() / w.sum()))


@vector_udf("double")
def _fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([_fisher(int(p), int(q), int(r), int(s)) for p, q, r, s in zip(a, b, c, d)], dtype="float64")


def fisher_2x2(df: DataFrame, row: Column, col: Column) -> DataFrame:
    """Two-sided exact test of two boolean expressions: cells, sample odds ratio, p."""
    cells = df.agg(F.count_if(row & col).alias("a"), F.count_if(row & ~col).alias("b"),
                   F.count_if(~row & col).alias("c"), F.count_if(~row & ~col).alias("d"))
    odds = F.when(F.col("b") * F.col("c") > 0,
                  F.col("a").cast("double") * F.col("d") / (F.col("b").cast("double") * F.col("c")))
    return cells.withColumns({"odds_ratio": odds, "p_value": _fisher_p("a", "b", "c", "d")})
