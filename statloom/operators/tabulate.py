"""Grouped statistics, contingency tables, shares, histograms and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.nulls import guarded, join_null_safe
from statloom.functions.ordered import quantiles, quantiles_wide


def group_stats(df: DataFrame, keys: list[str], value: str, na: str = "poison") -> DataFrame:
    """count, mean and exact median per group; groups keep their null key."""
    v = F.col(value)
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), guarded(F.avg(v), v, na).alias("mean"),
                                 F.count(v).alias("__k"))
    mid = quantiles(df, [value], [0.5], keys).select(*keys, F.col("q").alias("median"))
    out = join_null_safe(base, mid, keys, "left")
    if na == "poison":
        out = out.withColumn("median", F.when(F.col("n") == F.col("__k"), F.col("median")))
    return out.drop("__k")


def group_sum(df: DataFrame, keys: list, value: Column, out: str = "total", na: str = "poison") -> DataFrame:
    return df.groupBy(*keys).agg(guarded(F.sum(value), value, na).alias(out))


def group_count(df: DataFrame, keys: list) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def freq_table(df: DataFrame, cols: list[str], weight: Column | None = None) -> DataFrame:
    """One-way counts of every listed column in one pass; nulls are not tabulated."""
    w = F.lit(1) if weight is None else weight
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in cols]))
    return (df.select(w.alias("__w"), cells.alias("__r")).select("__r.*", "__w")
            .filter(F.col("level").isNotNull())
            .groupBy("variable", "level").agg(F.sum("__w").alias("n")))


def crosstab(df: DataFrame, cols: list[str], weight: Column | None = None) -> DataFrame:
    """n-way counts with the empty cells of the level cross product kept."""
    rows = df.select(*cols, (F.lit(1) if weight is None else weight).alias("__w")).dropna(subset=cols)
    counted = rows.groupBy(*cols).agg(F.sum("__w").alias("n"))
    cells = None
    for c in cols:
        levels = counted.select(c).distinct()
        cells = levels if cells is None else cells.crossJoin(levels)
    zero = F.lit(0) if weight is None else F.lit(0.0)
    return cells.join(counted, cols, "left").withColumn("n", F.coalesce("n", zero))


def crosstab_wide(df: DataFrame, row: str, col: str, levels: list) -> DataFrame:
    return df.groupBy(row).pivot(col, levels).agg(F.count(F.lit(1))).fillna(0)


def add_share(table: DataFrame, within: list[str] = (), n: str = "n", out: str = "share",
              percent_digits: int | None = None) -> DataFrame:
    """Share of the grand total, or within a margin; runs on the small counted table."""
    total = F.sum(n).over(Window.partitionBy(*(within or [F.lit(0)])))
    share = F.try_divide(F.col(n), total)
    if percent_digits is not None:
        share = F.round(share * 100, percent_digits)
    return table.withColumn(out, share)


def dominant_levels(df: DataFrame, cols: list[str], threshold: float = 0.85) -> DataFrame:
    """Levels that hold at least ``threshold`` of their column."""
    return add_share(freq_table(df, cols), ["variable"]).filter(F.col("share") >= threshold)


def quantile_table(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Quantiles of several variables side by side: one row per probability."""
    long = quantiles(df, cols, probs)
    return long.groupBy("prob").agg(*[F.max(F.when(F.col("variable") == c, F.col("q"))).alias(c) for c in cols])


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """All pairs in long form, from one aggregate; for wide tables use the Gramian in ``linear``."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
                   for i, (a, b) in enumerate(pairs)])
    both = []
    for i, (a, b) in enumerate(pairs):
        both.append((a, b, i))
        if a != b:
            both.append((b, a, i))
    cells = F.explode(F.array(*[
        F.struct(F.lit(a).alias("var_i"), F.lit(b).alias("var_j"), F.col(f"r{i}").alias("r")) for a, b, i in both]))
    return one.select(cells.alias("c")).select("c.*")


def cov_means(df: DataFrame, cols: list[str]) -> DataFrame:
    """Covariance matrix in long form with the mean of the row variable."""
    one = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)])
    cells = F.explode(F.array(*[
        F.struct(F.lit(a).alias("var_i"), F.lit(b).alias("var_j"),
                 F.col(f"m{i}").alias("mean_i"), F.col(f"c{i}_{j}").alias("cov"))
        for i, a in enumerate(cols) for j, b in enumerate(cols)]))
    return one.select(cells.alias("c")).select("c.*")


def histogram(df: DataFrame, value: str, bins: int = 30, keys: list[str] = (),
              weight: Column | None = None) -> DataFrame:
    """Equal-width bins over the value range; the largest value falls in the last bin."""
    w = F.lit(1) if weight is None else weight
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"), w.alias("__w")).filter(F.col("__v").isNotNull())
    span = rows.agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    return (rows.crossJoin(F.broadcast(span))
            .withColumn("bin", F.when(width > 0, F.least(F.floor((F.col("__v") - F.col("__lo")) / width),
                                                         F.lit(bins - 1))).otherwise(F.lit(0)).cast("int"))
            .groupBy(*keys, "bin", (F.col("__lo") + F.col("bin") * width).alias("bin_start"))
            .agg(F.sum("__w").alias("n")))


def group_bars(df: DataFrame, x: str, facet: str, value: str) -> DataFrame:
    """Chart-ready table: median per x and facet, count and a formatted label."""
    stats = group_stats(df, [x, facet], value)
    return stats.withColumn("label", F.format_number(F.round("median", 0), 0))


def hier_rollup(df: DataFrame, index: list[str], hierarchy: list[str], value: Column, out: str = "total") -> DataFrame:
    """Per index: leaf rows and one row per parent level; ``is_aggregated`` marks the totals.

    Leaves are summed first, so the level expansion multiplies the small table and not the rows.
    """
    leaves = df.groupBy(*index, *hierarchy).agg(F.sum(value).alias("__v"))
    sets = [[F.col(c) for c in [*index, *hierarchy[:k]]] for k in range(len(hierarchy), -1, -1)]
    flag = F.grouping(hierarchy[-1]).cast("boolean")
    return leaves.groupingSets(sets, *index, *hierarchy).agg(
        F.sum("__v").alias(out), flag.alias("is_aggregated"),
        sum((F.grouping(h) for h in hierarchy[1:]), F.grouping(hierarchy[0])).cast("int").alias("levels_up"))


def confusion(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Counts by predicted and actual class with the overall accuracy on each row."""
    counted = df.groupBy(predicted, actual).agg(F.count(F.lit(1)).alias("n"))
    right = F.sum(F.when(F.col(predicted) == F.col(actual), F.col("n")).otherwise(0))
    return counted.crossJoin(F.broadcast(counted.agg((right / F.sum("n")).alias("accuracy"))))


def scalar_summary(df: DataFrame, value: str) -> DataFrame:
    """mean, median, max and sum of one column."""
    one = df.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.sum(value).alias("total"))
    mid = quantiles_wide(df, [value], {"median": 0.5}).select("median")
    return one.crossJoin(mid)
